"""Splits that keep related records together.

Records and the values they share (author, source, entity) are nodes of one graph.  The component table persists between
batches: ``nodes`` says to which component a node was given, ``pointers`` leads a merged component to the one it
became, and following the pointers by jumping gives the present component.  A batch only works on its own nodes and the components
they touch.  Existing components keep their split, new ones fill the deficits of the splits, and what joins
components (or labels) of different splits is quarantined instead of moved; with ``resolve`` it fills deficits like a new one, and
then records can move.

Scale: a value shared by a third of all records is one node whose least neighbour is a partial aggregate; no pair of records
is ever made.  A batch follows pointers only for the components it touches and adds its nodes to the table instead of rewriting
it.  New components take their splits in order of size, then of the hash of their name: those above one part in
``FINE`` of all records, at most as many, one by one, all others through a histogram of ``FINE`` bins, so every split is filled
to within one part in ``FINE`` of the records and one component.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.operators.components import connected_components
from spanwork.session import stage_table, unstage

#: Parts of all records down to which deficits are filled; also the most rows that the driver sees.
FINE = 10_000


@dataclass
class Components:
    """The persisted state. nodes: node, component. pointers: component, parent, split, status, n_records."""

    nodes: DataFrame
    pointers: DataFrame

    def save(self, folder: str) -> None:
        self.nodes.write.parquet(f"{folder}/nodes")
        self.pointers.write.parquet(f"{folder}/pointers")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Components:
        return Components(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/pointers"))

    def roots(self, spark: SparkSession, components: DataFrame) -> DataFrame:
        """component, now: where the pointers of ``components`` lead after all merges."""
        at = components.select("component", F.col("component").alias("now"))
        up = self.pointers.where("component <> parent").select(F.col("component").alias("now"), "parent")
        held = None
        while True:
            moved = at.join(up, "now", "left").select("component", F.coalesce("parent", "now").alias("now"), F.col("parent").isNotNull().alias("moved"))
            step = stage_table(spark, moved, "roots")
            if held is not None:
                unstage(spark, held)
            at, held = step.select("component", "now"), step
            if step.where("moved").isEmpty():
                return at

    def present(self, spark: SparkSession, nodes: DataFrame | None = None) -> DataFrame:
        """node, component, split, status after all merges, of all nodes or those in ``nodes``."""
        mine = self.nodes if nodes is None else self.nodes.join(nodes, "node", "left_semi")
        to = self.roots(spark, mine.select("component").distinct())
        state = self.pointers.where("component = parent").select(F.col("component").alias("now"), "split", "status")
        return mine.join(to, "component").join(state, "now").select("node", F.col("now").alias("component"), "split", "status")


def _fill(spark: SparkSession, fresh: DataFrame, held: dict[str, int], shares: dict[str, float]) -> DataFrame:
    """component, split for components without one (component, n): large ones first, each where most is missing."""
    coming = fresh.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    total = coming + sum(held.values())
    names = sorted(shares)
    missing = {s: shares[s] * total - held.get(s, 0) for s in names}
    least = total / FINE
    placed = []
    for r in fresh.where(F.col("n") > least).orderBy(F.desc("n"), F.xxhash64("component"), "component").collect():  # fewer than FINE rows
        best = max(names, key=lambda s: (missing[s], s))
        missing[best] -= r["n"]
        placed.append((r["component"], best))
    small = fresh.where(F.col("n") <= least).withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(FINE)))
    bins = []
    for r in small.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():  # at most FINE rows
        best = max(names, key=lambda s: (missing[s], s))
        missing[best] -= r["n"]
        bins.append((r["bin"], best))
    to = spark.createDataFrame(bins, "bin long, split string")
    return spark.createDataFrame(placed, "component string, split string").unionByName(small.join(F.broadcast(to), "bin").select("component", "split"))


def assign_related(
    spark: SparkSession,
    records: DataFrame,
    key: str,
    links: dict[str, Column],
    split: Column | None,
    shares: dict[str, float],
    before: Components | None = None,
    resolve: bool = False,
) -> Components:
    """``records`` has one row per ``key``; ``links`` gives the values that relate records, ``split`` the split a record already has.

    Nulls: a null link links nothing, a null key is left out, a null split is no split.  A record without any link is a component
    of its own.  A batch that repeats records of an earlier one changes nothing for them.  An empty batch returns
    the state it was given.  Columns of other names are ignored.  ``resolve`` gives every component a split, torn ones too.
    """
    rows = records.where(F.col(key).isNotNull()).select(
        F.concat(F.lit("record:"), F.col(key).cast("string")).alias("record"),
        (split if split is not None else F.lit(None).cast("string")).alias("label"),
        F.array_compact(F.array(*[F.concat(F.lit(f"{n}:"), c) for n, c in links.items()])).alias("values"),
    )
    rows = stage_table(spark, rows, "records")
    edges = rows.select("record", F.explode(F.array_append("values", F.col("record"))).alias("value"))
    known_pointers = None
    if before is not None:
        nodes = edges.select(F.explode(F.array("record", "value")).alias("node")).distinct()
        touched = stage_table(spark, before.present(spark, nodes), "touched")
        edges = edges.unionByName(touched.select(F.col("node").alias("record"), F.concat(F.lit("old:"), "component").alias("value")))
        known_pointers = before.pointers
    label = connected_components(spark, edges)

    # what each component of this batch holds: new records with their labels, and old components with their splits
    have = label.join(rows.select(F.col("record").alias("node"), "label"), "node")
    if before is not None:
        have = have.join(touched.select("node"), "node", "left_anti")
    fresh = have.select("component", F.lit(1).alias("n"), "label", F.lit(None).cast("string").alias("old"), F.lit(False).alias("bad"))
    if before is not None:
        state = before.pointers.where("component = parent").select(F.concat(F.lit("old:"), "component").alias("node"), "split", "status", "n_records")
        old = label.join(state, "node").select(
            "component", F.col("n_records").alias("n"), F.col("split").alias("label"), F.expr("substr(node, 5)").alias("old"), (F.col("status") == "quarantined").alias("bad")
        )
        fresh = fresh.unionByName(old)
    facts = fresh.groupBy("component").agg(
        F.sum("n").alias("n"), F.collect_set("label").alias("labels"), F.min("old").alias("old"), F.max("bad").alias("bad")
    )  # labels are the names of splits: a handful
    facts = stage_table(
        spark,
        facts.select(
            F.col("component").alias("batch"),
            F.coalesce("old", "component").alias("component"),
            "n",
            F.when(F.size("labels") == 1, F.col("labels")[0]).alias("split"),
            (F.lit(not resolve) & (F.col("bad") | (F.size("labels") > 1))).alias("conflict"),
        ),
        "facts",
    )
    count = facts.where(~F.col("conflict") & F.col("split").isNotNull()).groupBy("split").agg(F.sum("n").alias("n"))
    held = {r["split"]: r["n"] for r in count.collect()}
    if before is not None:  # components this batch does not touch
        rest = known_pointers.where("component = parent and status = 'assigned'").join(facts.select("component"), "component", "left_anti")
        for r in rest.groupBy("split").agg(F.sum("n_records").alias("n")).collect():
            held[r["split"]] = held.get(r["split"], 0) + r["n"]
    filled = _fill(spark, facts.where("not conflict and split is null").select("component", "n"), held, shares)
    roots = facts.join(filled.withColumnRenamed("split", "given"), "component", "left").select(
        "component",
        F.col("component").alias("parent"),
        F.when(~F.col("conflict"), F.coalesce("split", "given")).alias("split"),
        F.when(F.col("conflict"), "quarantined").otherwise("assigned").alias("status"),
        F.col("n").alias("n_records"),
    )
    names = facts.select(F.col("batch"), F.col("component").alias("now"))
    pointers = roots
    fresh_nodes = label.where(~F.col("node").startswith("old:")).join(names.withColumnRenamed("batch", "component"), "component").select("node", F.col("now").alias("component"))
    if before is not None:
        merged = label.where(F.col("node").startswith("old:")).join(names.withColumnRenamed("batch", "component"), "component").select(
            F.expr("substr(node, 5)").alias("component"), F.col("now").alias("parent")
        )
        moved = merged.where("component <> parent").select(
            "component", "parent", F.lit(None).cast("string").alias("split"), F.lit("merged").alias("status"), F.lit(0).cast("long").alias("n_records")
        )
        kept = known_pointers.join(roots.select("component"), "component", "left_anti").join(moved.select("component"), "component", "left_anti")
        pointers = kept.unionByName(roots).unionByName(moved)
        fresh_nodes = fresh_nodes.join(touched.select("node"), "node", "left_anti")
    nodes = stage_table(spark, fresh_nodes, "nodes")
    return Components(nodes if before is None else before.nodes.unionByName(nodes), stage_table(spark, pointers, "pointers"))


def assignments(spark: SparkSession, state: Components) -> DataFrame:
    """record, component, split (null while quarantined), status."""
    rows = state.present(spark).where(F.col("node").startswith("record:"))
    return rows.select(F.expr("substr(node, 8)").alias("record"), "component", "split", "status")
