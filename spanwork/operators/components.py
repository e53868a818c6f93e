"""Connected components by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.session import stage_table, unstage


def _jump(spark: SparkSession, parent: DataFrame) -> DataFrame:
    """Follow pointers (node, parent) until each leads to a root: every step halves what is left of each path."""
    held = None
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        wider = parent.join(up, "parent", "left").select(
            "node", F.coalesce("grand", "parent").alias("next"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")
        )
        wider = stage_table(spark, wider, "jump")
        if held is not None:
            unstage(spark, held)
        held = wider
        parent = wider.select("node", F.col("next").alias("parent"))
        if wider.where("moved").isEmpty():
            return parent


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges`` has two columns of one type; the result has ``node`` and ``component``, the least node of its component.

    Nulls name no node and their edges are left out; an edge from a node to itself makes the node a component of its own;
    repeated edges count once; no edges give no rows.

    Each round points every node to its least neighbour (a partial aggregate, so a node with very many edges is no hot
    spot), jumps along the pointers to their roots, and contracts the edges to those roots.  Rounds are few because
    each at least halves the nodes that still have edges; every round's tables are written to the shared folder.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = stage_table(spark, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    live = stage_table(spark, pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = nodes.select("node", F.col("node").alias("component"))
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
        parent = both.select("e.*").groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
        root = _jump(spark, stage_table(spark, parent, "parent"))
        before, edges_before = label, live
        label = stage_table(
            spark,
            label.join(root.select(F.col("node").alias("component"), F.col("parent").alias("root")), "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")
            ),
            "label",
        )
        ra = root.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rb = root.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        moved = live.join(ra, "a").join(rb, "b").where("ra <> rb")
        live = stage_table(spark, moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        unstage(spark, before, edges_before)
    return label
