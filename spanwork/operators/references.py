"""References to elements: each returns (ref, id) for all elements that fit; a reference holds if exactly one does.

``elements`` has id, storey, x, y, z (whole millimetres); ``refs`` has ref and the columns of its anchor (ax, ay, az, storey).
All conditions are equi-joins on the storey with the rest as residual filters, or windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(matches: DataFrame) -> DataFrame:
    """References that exactly one element answers."""
    return matches.groupBy("ref").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1").select("ref", "id")


def _near(refs: DataFrame, elements: DataFrame) -> DataFrame:
    return refs.join(elements, "storey").where("id <> ref")


def _square(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def nearest(refs: DataFrame, elements: DataFrame, margin: int) -> DataFrame:
    """Elements whose squared plan distance is at most the least one plus ``margin``."""
    rows = _near(refs, elements).withColumn("_d", _square("x", "ax") + _square("y", "ay"))
    rows = rows.withColumn("_t", F.min("_d").over(Window.partitionBy("ref")))
    return rows.where(F.col("_d") <= F.col("_t") + margin).select("ref", "id")


def knn(refs: DataFrame, elements: DataFrame, k: int) -> DataFrame:
    rows = _near(refs, elements).withColumn("_d", _square("x", "ax") + _square("y", "ay") + _square("z", "az"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy("_d", "id"))).where(F.col("place") <= k).select("ref", "id", "place")


def offset(refs: DataFrame, elements: DataFrame, step: int, tolerance: int) -> DataFrame:
    """At ``step`` along x from the anchor, within a tolerance along and across."""
    ok = (F.abs(F.col("x") - F.col("ax") - step) <= tolerance) & (F.abs(F.col("y") - F.col("ay")) <= tolerance)
    return _near(refs, elements).where(ok).select("ref", "id")


def extreme(elements: DataFrame, axis: str, margin: int) -> DataFrame:
    """Elements of a storey within ``margin`` of the greatest value; the storey is the reference."""
    top = F.max(axis).over(Window.partitionBy("storey"))
    return elements.where(F.col("storey").isNotNull()).withColumn("_t", top).where(F.col(axis) >= F.col("_t") - margin).select(F.col("storey").alias("ref"), "id")


def between(refs: DataFrame, elements: DataFrame, cap: int) -> DataFrame:
    """Between two anchors along x, inset by a twentieth of their distance, at most ``cap`` from their line's middle."""
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    inset = F.floor((high - low) / 20)
    ok = (F.col("x") > low + inset) & (F.col("x") < high - inset) & (F.abs(2 * F.col("y") - F.col("ay") - F.col("by")) <= 2 * cap)
    return _near(refs, elements).where(ok).select("ref", "id")


def above(refs: DataFrame, elements: DataFrame, cap: int, rise: int) -> DataFrame:
    """Higher by more than ``rise`` at a plan distance of at most ``cap``."""
    return _near(refs, elements).where((_square("x", "ax") + _square("y", "ay") <= cap * cap) & (F.col("z") - F.col("az") > rise)).select("ref", "id")


def beside(refs: DataFrame, elements: DataFrame, reach: int) -> DataFrame:
    """On the left of the direction (dx, dy) in which the anchor looks, by a cross product of at least ``reach``."""
    cross = F.col("dx") * (F.col("y") - F.col("ay")) - F.col("dy") * (F.col("x") - F.col("ax"))
    return _near(refs, elements).where(cross >= reach).select("ref", "id")


def opposite(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """Nearest to the anchor's mirror image at the middle of the storey; equally near ones are all returned."""
    mid = elements.groupBy("storey").agg((F.min("x") + F.max("x")).alias("sx"), (F.min("y") + F.max("y")).alias("sy"))
    rows = _near(refs, elements).join(mid, "storey")
    d = (F.col("x") - F.col("sx") + F.col("ax")) * (F.col("x") - F.col("sx") + F.col("ax")) + (F.col("y") - F.col("sy") + F.col("ay")) * (F.col("y") - F.col("sy") + F.col("ay"))
    rows = rows.withColumn("_d", d).withColumn("_t", F.min("_d").over(Window.partitionBy("ref")))
    return rows.where(F.col("_d") == F.col("_t")).select("ref", "id")


def ordinal(elements: DataFrame, axis: str, place: int, gap: int) -> DataFrame:
    """The element at a place along an axis, only if it is clear of its neighbours by ``gap``."""
    by = Window.partitionBy("storey").orderBy(axis, "id")
    rows = elements.where(F.col("storey").isNotNull()).select("storey", "id", F.row_number().over(by).alias("_n"), (F.col(axis) - F.lag(axis).over(by)).alias("_a"), (F.lead(axis).over(by) - F.col(axis)).alias("_b"))
    return rows.where((F.col("_n") == place) & (F.coalesce("_a", F.lit(gap)) >= gap) & (F.coalesce("_b", F.lit(gap)) >= gap)).select(F.col("storey").alias("ref"), "id")


def larger_than(elements: DataFrame, measure: str, least: int) -> DataFrame:
    """The set of a storey above a measure; one unknown measure leaves the whole set undecided."""
    unknown = F.max(F.col(measure).isNull().cast("int")).over(Window.partitionBy("storey"))
    return elements.withColumn("_u", unknown).where((F.col("_u") == 0) & (F.col(measure) > least)).select(F.col("storey").alias("ref"), "id")


def related(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sources with an edge to both targets of a reference: ``pairs`` has ref and other, ``edges`` src and dst without repetition."""
    one = pairs.join(edges.select(F.col("dst").alias("ref"), "src"), "ref")
    return one.join(edges.select(F.col("dst").alias("other"), "src"), ["other", "src"]).select("ref", F.col("src").alias("id"))


def unrelated(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements without any edge, per storey."""
    return elements.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("storey").alias("ref"), "id")
