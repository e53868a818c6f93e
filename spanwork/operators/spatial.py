"""Boxes and points: grid joins instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(low: Column, high: Column, size: int) -> Column:
    """Numbers of the grid cells that an interval touches."""
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def overlap_join(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(a, b) of boxes (id, x0, x1, y0, y1) that overlap: boxes meet in grid cells, each pair only in the cell that holds the
    lower corner of what they share.  ``size`` should be about the size of a box."""
    def gridded(df: DataFrame, p: str) -> DataFrame:
        rows = df.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "x1", "y0", "y1")])
        rows = rows.withColumn("cx", F.explode(cells(F.col(f"{p}x0"), F.col(f"{p}x1"), size)))
        return rows.withColumn("cy", F.explode(cells(F.col(f"{p}y0"), F.col(f"{p}y1"), size)))

    both = gridded(a, "a").join(gridded(b, "b"), ["cx", "cy"])
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    corner = (F.floor(F.greatest("ax0", "bx0") / size) == F.col("cx")) & (F.floor(F.greatest("ay0", "by0") / size) == F.col("cy"))
    return both.where(meet & corner).select("a", "b", "ax0", "ax1", "ay0", "ay1", "bx0", "bx1", "by0", "by1")


def gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Distance of two intervals, 0 where they touch."""
    return F.greatest(F.lit(0), low - other_high, other_low - high)


def within_distance(points: DataFrame, reach: int) -> DataFrame:
    """(a, b) of points (id, x, y) at most ``reach`` apart, a < b: each point looks into its own cell and the eight around it."""
    at = points.select("id", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    look = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy", around).select("b", "bx", "by", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    d = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    return at.join(look, ["cx", "cy"]).where((F.col("id") < F.col("b")) & (d <= reach * reach)).select(F.col("id").alias("a"), "b")


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 if a, b, c turn left, -1 if right, 0 on one line."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Segments (x0, y0, x1, y1) that cross properly: each has the other's ends on both sides."""
    a, b, c, d = p[:2], p[2:], q[:2], q[2:]
    return (turn(*a, *b, *c) * turn(*a, *b, *d) < 0) & (turn(*c, *d, *a) * turn(*c, *d, *b) < 0)
