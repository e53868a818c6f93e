"""Set-similarity joins by prefix filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from spanwork.session import stage_table

#: Members are counted in 2^22 counters, sent in slices of 2^16.
COUNTERS, SLICE = 22, 16
#: Documents sorted at once, and members a group of the join is made for.
CHUNK, SHARE = 1 << 13, 8_000_000
#: Bits of the parity map of a set of at most 192 members; every doubling of the size doubles them.
BITS, UPTO = 128, 192
#: Documents of pairs that are broadcast; more of them are joined by shuffle.
FEW = 200_000
_LOW = np.uint64((1 << 42) - 1)


def _hashes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _band(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, UPTO) / UPTO)).astype(np.int64)


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTERS, dtype=np.uint32)
    for batch in batches:
        if batch.num_rows:
            h, _ = _hashes(batch.column(0))
            counts += np.bincount((h >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS).astype(np.uint32)
    if counts.any():
        slices = counts.reshape(-1, 1 << SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([s.tobytes() for s in slices], pa.binary())], ["slice", "counts"])


def _level(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), dtype=np.uint32).astype(np.int64) for c in table.column("counts"))
    level = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
    return pa.table({"slice": table.column("slice").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "level": pa.array([level.tobytes()], pa.binary())})


def _parities(h: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """For each set, bit i tells whether an odd number of its members hash to i: two maps differ in no more bits than the sets in members."""
    at = np.repeat(np.arange(len(n)) * width, n) + ((h >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=len(n) * width) & 1).astype(np.uint8).reshape(len(n), width), axis=1)


def _prefixes(levels: np.ndarray, buckets: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (band of sizes, bucket of members): the sets with members of the bucket among their rarest, and these members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                yield from chunk(batch.slice(begin, CHUNK))

    def chunk(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, copies = batch.column(0), batch.column(2)
        h, n = _hashes(batch.column(1))
        doc = np.repeat(np.arange(len(n)), n)
        code = (doc.astype(np.uint64) << np.uint64(50)) | (levels[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(42)) | (h & _LOW)
        code.sort()
        rarest = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] < (n - _least(n, threshold) + 1)[doc]
        doc_at, member = doc[rarest], code[rarest] & _LOW
        bucket = ((member >> np.uint64(10)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        doc_at, x = doc_at[order], (member[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        first, last = _band(_least(n, threshold)), _band(n)
        for band in range(int(last.max()) + 1):
            inside = (first <= band) & (band <= last)
            if not inside.any():
                continue
            maps = _parities(h[inside[doc]], n[inside], BITS << band)
            place = np.cumsum(inside) - 1
            rows = []
            for b in range(buckets):
                d, m = doc_at[ends[b] : ends[b + 1]], x[ends[b] : ends[b + 1]]
                keep = inside[d]
                sets, times = np.unique(d[keep], return_counts=True)
                if len(sets):
                    rows.append((b, sets, times.astype(np.int32), m[keep], maps[place[sets]].tobytes()))
            if rows:
                taken = np.concatenate([r[1] for r in rows])
                by_set = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]), pa.int32())
                by_member = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32())
                columns = [
                    pa.array([band] * len(rows), pa.int32()),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.ListArray.from_arrays(by_set, keys.take(pa.array(taken))),
                    pa.ListArray.from_arrays(by_set, copies.take(pa.array(taken))),
                    pa.ListArray.from_arrays(by_set, pa.array(n[taken].astype(np.int32))),
                    pa.ListArray.from_arrays(by_set, pa.array(np.concatenate([r[2] for r in rows]))),
                    pa.ListArray.from_arrays(by_member, pa.array(np.concatenate([r[3] for r in rows]))),
                    pa.array([r[4] for r in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["band", "bucket", "keys", "copies", "sizes", "times", "members", "maps"])

    return run


def _meet(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Sets of one group that share a member and whose sizes and parity maps allow the similarity; of copies only the least key."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda c: pc.list_flatten(table.column(c)).combine_chunks()
        band, keys, size, times = table.column("band")[0].as_py(), flat("keys"), flat("sizes").to_numpy().astype(np.int64), flat("times").to_numpy()
        maps = np.frombuffer(b"".join(table.column("maps").to_pylist()), dtype=np.uint64).reshape(len(size), -1)
        doc, x = np.repeat(np.arange(len(size)), times), flat("members").to_numpy()
        copies = pa.table({"copy": flat("copies"), "key": keys})
        by_copy = pc.sort_indices(copies, sort_keys=[("copy", "ascending"), ("key", "ascending")]).to_numpy()
        copy = copies.column("copy").combine_chunks().fill_null(0).to_numpy()[by_copy]
        known = copies.column("copy").is_valid().combine_chunks().to_numpy(zero_copy_only=False)[by_copy]
        stands = np.ones(len(size), dtype=bool)
        stands[by_copy[1:]] = (copy[1:] != copy[:-1]) | ~known[1:]
        doc, x = doc[stands[doc]], x[stands[doc]]
        order = np.lexsort((size[doc], x))
        doc, x = doc[order], x[order]
        n = size[doc]
        left, step, found = np.flatnonzero(_band(n) == band), 0, [np.zeros(0, dtype=np.int64)]
        while len(left):
            step += 1
            left = left[left + step < len(x)]
            right = left + step
            left = left[(x[left] == x[right]) & (n[left] >= n[right] * threshold - 1e-9)]
            for begin in range(0, len(left), 1 << 16):
                i = left[begin : begin + (1 << 16)]
                p, q, both = doc[i], doc[i + step], n[i] + n[i + step]
                far = np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1, dtype=np.int64)
                near = far <= both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
                found.append(np.unique(p[near] * len(size) + q[near]))
        pairs = np.unique(np.concatenate(found))
        return pa.table({"a": keys.take(pa.array(pairs // max(1, len(size)))), "b": keys.take(pa.array(pairs % max(1, len(size))))})

    return run


def jaccard_pairs(sets: DataFrame, key: str, members: str | Column, threshold: float = 0.8, copy: str | Column | None = None) -> DataFrame:
    """(a, b, common, size_a, size_b) for every two different sets with a Jaccard similarity of at least ``threshold``.

    ``sets`` has one row per ``key`` and an array of distinct strings, or of their 64-bit hashes; empty and null sets match nothing.
    An expression for ``members`` is evaluated in the end for the sets of pairs only.
    Members are ordered by how often the counter they hash to was met; two similar sets share one of their first
    n - ceil(t n) + 1 members in whatever order, so only those meet, and only rare members are among them.  Where two meet, the sizes
    and parity maps, which bound the difference of the sets, are compared before a pair is written; what is left is verified on all members.
    The members of all sets are never written: ``sets`` is read twice, and once more for the sets of pairs.
    Pass one representative of exact copies, or the name of a ``copy`` column of longs: of equal ones only the least key stands.
    """
    spark = sets.sparkSession
    given = F.col(members) if isinstance(members, str) else members
    kind = sets.select(given.alias("m")).schema["m"].dataType.elementType
    hashed = given if kind == LongType() else F.transform(given, lambda m: F.xxhash64(m))
    same = F.lit(None).cast("long") if copy is None else F.col(copy) if isinstance(copy, str) else copy
    base = sets.select(F.col(key).alias("key"), hashed.alias("m"), same.alias("copy"))
    counted = base.select("m").mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_level, "slice int, total long, level binary").collect()
    levels = np.frombuffer(b"".join(bytes(r.level) for r in sorted(counted, key=lambda r: r.slice)), dtype=np.uint8)
    buckets = max(12, -(-sum(r.total for r in counted) // SHARE))
    kind, ints = base.schema["key"].dataType, ArrayType(IntegerType())
    lists = [("keys", ArrayType(kind)), ("copies", ArrayType(LongType())), ("sizes", ints), ("times", ints), ("members", ints), ("maps", BinaryType())]
    schema = StructType([StructField(c, t) for c, t in [("band", IntegerType()), ("bucket", IntegerType()), *lists]])
    met = base.mapInArrow(_prefixes(levels, buckets, threshold), schema).groupBy("band", "bucket").applyInArrow(_meet(threshold), StructType([StructField("a", kind), StructField("b", kind)]))
    pairs = stage_table(spark, met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ids = stage_table(spark, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "candidate-ids")
    known = F.coalesce(hashed, F.array().cast("array<bigint>"))  # else a filter on null members, for all sets, is put before the join
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    full = sets.join(ids, sets[key] == ids["key"], "left_semi").select(F.col(key).alias("key"), known.alias("o")).select("key", "o", F.size("o").alias("n"))
    both = pairs.join(full.toDF("a", "o_a", "size_a"), "a").join(full.toDF("b", "o_b", "size_b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("o_a", "o_b")))
    keep = F.col("common") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9
    return both.where(keep).select("a", "b", "common", "size_a", "size_b")
