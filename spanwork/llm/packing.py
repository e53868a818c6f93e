"""Fill containers of fixed capacity with texts, measured in tokens.

Bounded-space online packing: every partition keeps at most ``OPEN`` windows per capacity; a text goes to the window it fits best, and
when none fits, the fullest is emitted and a new one opened.  What is still open at the end of the partitions is merged:
whole windows of ``GROUP`` partitions, largest first, each where it fits best.  A text is cut only if it is larger than the
capacity; its full pieces fill containers of their own and its rest is packed like any other text.

Scale: texts are tokenised once, in a map; what is packed afterwards is their ids and sizes.  A task holds only its open windows,
never the texts in them, since a text's container is known when it is placed; merging sees windows, not texts.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.session import stage_table

#: Vocabulary file of a public byte-level tokenizer (token in base64 and rank per line), and how it splits texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Open windows per capacity and partition, texts of one partition, and partitions whose leftovers are merged together.
OPEN, ROWS, GROUP = 512, 20_000, 64


def load_tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) per row; a null or empty text has 0 tokens."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or load_tokenizer(tokenizer).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long")


class Windows:
    """Open windows of one capacity, by free space."""

    def __init__(self, capacity: int, most: int, name: str) -> None:
        self.capacity, self.most, self.name = capacity, most, name
        self.free: list[tuple[int, int]] = []  # sorted (free space, number)
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The number of the container that takes ``size`` tokens."""
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            left, number = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                self.free.pop(0)  # the fullest is emitted
            left, number = self.capacity, self.new()
        if left > size or size == 0:
            insort(self.free, (left - size, number))
        return number

    def id(self, number: int) -> str:
        return f"{self.name}-{number}"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number per size: the largest first, each where it leaves least."""
    free: list[tuple[int, int]] = []
    out, made = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            left, number = free.pop(k)
        else:
            left, number, made = capacity, made, made + 1
        insort(free, (left - sizes[i], number))
        out[i] = number
    return out


def pack(spark: SparkSession, counts: DataFrame, key: str, specs: list[tuple[int, int]], rows: int = ROWS, windows: int = OPEN) -> DataFrame:
    """``counts`` has ``key`` and ``n_tokens``; ``specs`` are (spec_id, capacity in tokens).

    One row per piece: spec_id, container_id, key, piece, start_token, n_tokens.  Rows with a null key are packed
    too.  A text without tokens takes part with 0 tokens.  Repeated keys are packed once each.  An empty table gives no
    rows; a capacity below 1 is an error.
    """
    if any(c is None or c < 1 for _, c in specs):
        raise ValueError("a capacity must be at least 1")
    counts = stage_table(spark, counts.select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "counts")
    parts = max(1, -(-counts.count() // rows))
    spread = counts.repartition(parts, F.xxhash64(key), "n_tokens") if parts > 1 else counts.coalesce(1)
    spread = spread.sortWithinPartitions(F.xxhash64(key), key, "n_tokens")  # a task that is run again packs alike
    kind = counts.schema[key].dataType.simpleString()
    schema = f"spec_id int, container_id string, {key} {kind}, piece int, start_token long, n_tokens long, part int, still_open boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sets = [(spec, Windows(capacity, windows, f"{spec}-{part}")) for spec, capacity in specs]

        def batch_of(taken: pa.Array, spec: list, ids: list, piece: list, start: list, size: list, still: bool) -> pa.RecordBatch:
            n = len(spec)
            made = [pa.array(spec, pa.int32()), pa.array(ids, pa.string()), taken, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([still] * n, pa.bool_())]
            return pa.RecordBatch.from_arrays(made, names=["spec_id", "container_id", key, "piece", "start_token", "n_tokens", "part", "still_open"])

        null = None
        for batch in batches:
            keys, null = batch.column(key), pa.nulls(1, batch.column(key).type)
            at, spec, ids, piece, start, size = [], [], [], [], [], []
            for i, n in enumerate(batch.column("n_tokens").to_pylist()):
                for s, w in sets:
                    full, rest = divmod(n, w.capacity)
                    for p in range(full + (rest > 0 or not full)):
                        tokens = w.capacity if p < full else rest
                        number = w.new() if p < full else w.place(rest)
                        at.append(i), spec.append(s), ids.append(w.id(number))
                        piece.append(p), start.append(p * w.capacity), size.append(tokens)
                    if len(at) > 50_000:
                        yield batch_of(keys.take(pa.array(at, pa.int32())), spec, ids, piece, start, size, False)
                        at, spec, ids, piece, start, size = [], [], [], [], [], []
            yield batch_of(keys.take(pa.array(at, pa.int32())), spec, ids, piece, start, size, False)
        if null is not None:  # the windows still open, with what they hold
            for s, w in sets:
                n = len(w.free)
                yield batch_of(null.take(pa.array([0] * n, pa.int32())), [s] * n, [w.id(k) for _, k in w.free], [-1] * n, [0] * n, [w.capacity - f for f, _ in w.free], True)

    packed = stage_table(spark, spread.mapInArrow(run, schema), "packed")
    capacity = dict(specs)

    def merge(group: pa.Table) -> pa.Table:
        ids, sizes = group.column("container_id").to_pylist(), group.column("n_tokens").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        spec, block = group.column("spec_id")[0].as_py(), group.column("block")[0].as_py()
        numbers = best_fit_decreasing([sizes[i] for i in order], capacity[spec])
        return pa.table({"container_id": pa.array([ids[i] for i in order], pa.string()), "merged_id": pa.array([f"{spec}-m{block}-{k}" for k in numbers], pa.string())})

    left = packed.where("still_open").select("spec_id", "container_id", "n_tokens", F.floor(F.col("part") / GROUP).alias("block"))
    merged = left.groupBy("spec_id", "block").applyInArrow(merge, "container_id string, merged_id string")
    placed = packed.where("not still_open").join(merged, "container_id", "left")
    return placed.select("spec_id", F.coalesce("merged_id", "container_id").alias("container_id"), key, "piece", "start_token", "n_tokens")
