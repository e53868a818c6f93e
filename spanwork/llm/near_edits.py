"""Records that differ by small edits, grouped by BK-trees over fingerprints.

Every canonical form has a 64-bit fingerprint; a BK-tree keeps the children of a node by their integer Hamming
distance to it, and a search within radius ``r`` follows only edges between ``d - r`` and ``d + r``.  Hits with the same figures are
verified on the words themselves, and what is linked, directly or through others, is one group.

Scale: trees are built per shard, never over the whole table.  Of ``r + 1`` parts of a fingerprint, two fingerprints within radius
``r`` share at least one, so a shard holds the forms of one split and source model with one part in common, and no pair
within the radius is lost.  A source model with a third of all rows falls into as many shards as it has different requests; no form
is searched for in any shard but its own ``r + 1``.  Trees travel to their queries by shuffle: the fingerprints of all records have no size
bound, so they are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.requests import requests_table, same_edit
from spanwork.operators.components import connected_components
from spanwork.session import stage_table

#: Bits in which the fingerprints of two near forms may differ.
RADIUS = 3
#: Records of one side of a group that meet in one task when pairs are listed.
SIDE = 2000
LINK = ["a_hi", "a_lo", "b_hi", "b_lo"]


class BKTree:
    """Fingerprints by Hamming distance; equal fingerprints share a node.  ``visited`` counts the nodes that searches came to."""

    def __init__(self) -> None:
        self.root: tuple[int, list, dict] | None = None
        self.nodes = self.visited = 0

    def add(self, key: int, item: object) -> None:
        if self.root is None:
            self.root, self.nodes = (key, [item], {}), 1
            return
        node = self.root
        while True:
            d = (node[0] ^ key).bit_count()
            if d == 0:
                node[1].append(item)
                return
            if d not in node[2]:
                node[2][d] = (key, [item], {})
                self.nodes += 1
                return
            node = node[2][d]

    def within(self, key: int, radius: int) -> Iterator[object]:
        stack = [self.root] if self.root else []
        while stack:
            at, items, children = stack.pop()
            self.visited += 1
            d = (at ^ key).bit_count()
            if d <= radius:
                yield from items
            stack.extend(child for edge, child in children.items() if d - radius <= edge <= d + radius)


def bands(radius: int) -> list[tuple[int, int]]:
    """Shift and mask of the ``radius + 1`` parts of a fingerprint."""
    edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def search(rows: Iterable[tuple], radius: int) -> Iterator[tuple[tuple, tuple]]:
    """Links (hi, lo) to (hi, lo) among rows (shard, print, fig, hi, lo) that come sorted by shard: the same figures, prints within the radius.

    A node holds forms by their figures, so forms that share a print but no figures do not meet.
    """
    at, tree = None, BKTree()
    for shard, key, fig, hi, lo in rows:
        if shard != at:
            at, tree = shard, BKTree()
        key &= (1 << 64) - 1
        mine = None
        for item in tree.within(key, radius):
            if fig in item[1]:
                yield from (((hi, lo), other) for other in item[1][fig])
            if item[0] == key:
                mine = item
        if mine is None:
            tree.add(key, (key, {fig: [(hi, lo)]}))
        else:
            mine[1].setdefault(fig, []).append((hi, lo))


@dataclass
class Groups:
    members: DataFrame  # rec_id, part, hi, lo, g_hi, g_lo
    links: DataFrame  # part, a_hi, a_lo, b_hi, b_lo: different forms that ask for the same edit

    def pairs(self) -> DataFrame:
        """All pairs of each group; one side of a large group is cut into parts that meet the other side in different tasks."""
        keys = ["part", "g_hi", "g_lo"]
        sizes = self.members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        sized = self.members.join(sizes, keys).withColumn("cuts", F.ceil(F.col("n") / F.lit(SIDE)).cast("int"))
        a = sized.select(*keys, F.pmod(F.xxhash64("rec_id"), F.col("cuts")).cast("int").alias("cut"), F.col("rec_id").alias("rec_id_a"))
        b = sized.select(*keys, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("rec_id").alias("rec_id_b"))
        return a.join(b, [*keys, "cut"]).where("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b")


def near_edit_groups(spark: SparkSession, task: DataFrame, radius: int = RADIUS, threshold: float = 0.8) -> Groups:
    """Groups of records of one split and source model that ask for the same edit.

    Nulls: a record without id, split, path or text takes no part.  Empty tables give no groups.  Repeated
    deliveries count once, the latest; copies share a form and so a group.  Texts of any length are used whole.
    """
    found = requests_table(spark, task, fingerprints=True)
    words, wordings = found.words, found.wordings
    part = F.xxhash64("split", "block").alias("part")
    members = stage_table(spark, found.members().select("rec_id", part, "hi", "lo"), "members")
    forms = members.select("part", "hi", "lo").distinct()
    prints = found.rows.where(F.col("block").isNotNull()).groupBy("hi", "lo").agg(F.first("print").alias("print"), F.first("fig").alias("fig"))
    cut = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("print", at).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("v")) for k, (at, mask) in enumerate(bands(radius))]
    rows = forms.join(prints.hint("merge"), ["hi", "lo"]).withColumn("b", F.explode(F.array(*cut)))
    rows = rows.select("part", F.xxhash64("part", "b.band", "b.v").alias("shard"), "print", "fig", "hi", "lo")

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def crowded() -> Iterator[tuple]:
            """Rows of shards that hold more than one."""
            last: tuple | None = None
            open_shard = False
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "print", "fig", "hi", "lo"))):
                    if last is not None and (r[0] == last[0] or open_shard):
                        yield last
                    open_shard = last is not None and r[0] == last[0]
                    last = r
            if last is not None and open_shard:
                yield last

        out: list[tuple] = []
        for (ah, al), (bh, bl) in search(crowded(), radius):
            out.append((ah, al, bh, bl) if (ah, al) < (bh, bl) else (bh, bl, ah, al))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=LINK)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=LINK)

    placed = rows.repartition("shard").sortWithinPartitions("shard", "hi", "lo").select("shard", "print", "fig", "hi", "lo")
    candidates = placed.mapInArrow(trees, ", ".join(f"{c} long" for c in LINK)).distinct()
    text = found.rows.where(F.col("block").isNotNull()).select("hi", "lo", "canonical").dropDuplicates(["hi", "lo"])
    candidates = stage_table(spark, candidates, "candidates")
    mine = candidates.select(F.explode(F.array(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")), F.struct(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")))).alias("c"))
    text = text.join(mine.select("c.*").distinct(), ["hi", "lo"], "left_semi")
    text = stage_table(spark, text, "texts")
    joined = candidates.join(text.toDF("a_hi", "a_lo", "a_text"), ["a_hi", "a_lo"]).join(text.toDF("b_hi", "b_lo", "b_text"), ["b_hi", "b_lo"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist())
            good = [_common(a, b) >= threshold and same_edit(a, b, words, wordings) for a, b in both]
            yield batch.select(LINK).filter(pa.array(good, pa.bool_()))

    verified = joined.select(*LINK, "a_text", "b_text").mapInArrow(verify, ", ".join(f"{c} long" for c in LINK))
    # forms hash their source model, so a link holds in every split that has both forms
    ends = lambda k: forms.select("part", F.col("hi").alias(f"{k}_hi"), F.col("lo").alias(f"{k}_lo"))
    links = verified.join(ends("a"), ["a_hi", "a_lo"]).join(ends("b"), ["part", "b_hi", "b_lo"]).select("part", *LINK)
    links = stage_table(spark, links, "links")
    name = lambda k: F.struct("part", F.col(f"{k}_hi").alias("hi"), F.col(f"{k}_lo").alias("lo")).alias(k)
    joined_up = connected_components(spark, links.select(name("a"), name("b")))
    joined_up = joined_up.select("node.part", "node.hi", "node.lo", F.col("component.hi").alias("g_hi"), F.col("component.lo").alias("g_lo"))
    grouped = members.join(joined_up, ["part", "hi", "lo"], "left")
    return Groups(grouped.select("rec_id", "part", "hi", "lo", F.coalesce("g_hi", "hi").alias("g_hi"), F.coalesce("g_lo", "lo").alias("g_lo")), links)


def _common(a: str, b: str) -> float:
    """Share of distinct tokens that two forms have in common."""
    x, y = set(a.split(" ")) - {";"}, set(b.split(" ")) - {";"}
    return len(x & y) / len(x | y)
