"""Passages of evaluation items inside a corpus, found by spaced-seed hashing.

Items are cut into runs of their own sentences (sentences that many items share are standing instructions and go).  Fixed
masks pick some of the tokens of a window and ignore the others; the hashes of all windows of all items are the index,
the hashes of all windows of all documents probe it, and around every hit the overlap is extended token by token,
letting slips, put-in words and a few exchanged words pass, but no other figure.

Scale: what items share (sentences and stretches) is counted over all of them by aggregation.  Then the set of items is taken in blocks
of ``BLOCK`` tokens, so the index that is broadcast has a fixed bound, and the size of a block changes no result; documents are read
once per block, whole, in a map without any shuffle.  A document that a third of all hits falls on is one row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.fold import fold
from spanwork.llm.requests import distance
from spanwork.session import stage_table

#: Token positions that count (1) or are ignored (0).
MASKS = ("1111", "11011", "101101", "1100011")
#: Tokens of the items of one pass over the documents; their index takes about a hundred bytes each.
BLOCK = 500_000
#: A sentence in so many items is a standing instruction.
SHARED = 3
#: Words of a stretch that make a leak; a whole sentence needs ``WHOLE`` of its words.
STRETCH, WHOLE = 13, 0.8
#: A stretch with fewer figures must not go on with another figure within so many words, nor stand in other items: such are templates.
FIGURES, NEAR = 2, 3
_TOKEN = re.compile(r"[a-z]/\d+|\d+(?:[.,]\d+)*|[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def words(text: str) -> list[str]:
    return _TOKEN.findall(text)


@lru_cache(500_000)
def same_word(a: str, b: str) -> bool:
    """Equal, or a slip of spelling in a word without digits."""
    if a == b:
        return True
    least = min(len(a), len(b))
    if least < 3 or not (a.isalpha() and b.isalpha()):
        return False
    return distance(a, b, 1 + (least > 5)) <= 1 + (least > 5)


Sentence = tuple[str, ...]


def item_sentences(text: str | None) -> list[Sentence]:
    return [w for s in _SENTENCE.split(fold(text)) if (w := tuple(words(s)))] if text else []


@dataclass
class Run:
    """Own sentences of an item that follow each other: tokens, spans of sentences, and where stretches begin that other items hold, too."""

    item: object
    tokens: Sentence
    spans: list[tuple[int, int]]
    shared: frozenset[int] = frozenset()


def item_runs(item: object, sentences: list[Sentence], standing: list[bool]) -> list[Run]:
    """The item without its standing instructions."""
    out: list[Run] = []
    tokens: list[str] = []
    spans: list[tuple[int, int]] = []
    for s, gone in [*zip(sentences, standing), ((), True)]:
        if not gone:
            spans.append((len(tokens), len(tokens) + len(s)))
            tokens += s
        elif tokens:
            out.append(Run(item, tuple(tokens), spans))
            tokens, spans = [], []
    return out


class Runs:
    """Runs of items, and the index of their spaced seeds."""

    def __init__(self, runs: list[Run]) -> None:
        self.runs = runs
        self.ids = {w: n for n, w in enumerate(sorted({w for r in runs for w in r.tokens}), 1)}
        hashes, places = [], []
        for n, r in enumerate(runs):
            ids = np.array([self.ids[w] for w in r.tokens], np.uint64)
            for m in range(len(MASKS)):
                h, at = seeds(ids, m)
                hashes.append(h)
                places.append(np.stack([np.full(len(at), n), at], axis=1))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.places = (np.concatenate(places) if places else np.zeros((0, 2), np.int64))[order]

    @staticmethod
    def of(items: list[tuple[object, str]]) -> Runs:
        """From items in memory."""
        cut = [(i, item_sentences(text)) for i, text in items]
        holders, stretches = defaultdict(set), defaultdict(set)
        for i, sentences in cut:
            for s in sentences:
                holders[s].add(i)
        runs = [r for i, sentences in cut for r in item_runs(i, sentences, [len(holders[s]) >= SHARED for s in sentences])]
        for r in runs:
            for k in range(len(r.tokens) - STRETCH + 1):
                stretches[r.tokens[k : k + STRETCH]].add(r.item)
        for r in runs:
            r.shared = frozenset(k for k in range(len(r.tokens) - STRETCH + 1) if len(stretches[r.tokens[k : k + STRETCH]]) > 1)
        return Runs(runs)


def prepared_runs(spark: SparkSession, items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, tokens, spans, shared: the runs of all items (a DataFrame with a null-free id and text)."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[" ".join(s) for s in item_sentences(t)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(item_id), pa.array(cut, pa.list_(pa.string()))], names=["item", "sentences"])

    texts = stage_table(spark, items.mapInArrow(cut, f"item {kind}, sentences array<string>").withColumn("text", F.xxhash64("sentences")), "items")
    each = texts.select("item", "text", F.posexplode("sentences").alias("at", "sentence"))
    standing = each.groupBy("sentence").agg(F.countDistinct("item").alias("n")).where(F.col("n") >= SHARED).select("sentence", F.lit(True).alias("gone"))
    marked = each.join(standing, "sentence", "left").groupBy("item", "text").agg(F.sort_array(F.collect_list(F.struct("at", "sentence", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("s"))
    arrow = "item {0}, run string, tokens array<string>, begins array<int>, ends array<int>".format(kind)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, at = [], []
            for k, (item, key, s) in enumerate(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), batch.column("s").to_pylist())):
                for n, r in enumerate(item_runs(item, [tuple(x["sentence"].split(" ")) for x in s], [x["gone"] for x in s])):
                    runs.append((f"{item}|{key}|{n}", r))
                    at.append(k)
            columns = [batch.column("item").take(pa.array(at, pa.int64())), pa.array([k for k, _ in runs], pa.string()), pa.array([list(r.tokens) for _, r in runs], pa.list_(pa.string()))]
            columns += [pa.array([[x[k] for x in r.spans] for _, r in runs], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "run", "tokens", "begins", "ends"])

    runs = stage_table(spark, marked.mapInArrow(own, arrow), "runs")
    starts = F.sequence(F.lit(0), F.size("tokens") - STRETCH)
    long = runs.where(F.size("tokens") >= STRETCH).select("item", "run", F.explode(F.transform(starts, lambda k: F.struct(k.alias("at"), F.xxhash64(F.slice("tokens", k + 1, STRETCH)).alias("h")))).alias("x"))
    long = long.select("item", "run", "x.at", "x.h")
    often = long.groupBy("h").agg(F.countDistinct("item").alias("n")).where("n > 1").select("h")
    shared = long.join(often, "h", "left_semi").groupBy("run").agg(F.collect_list("at").alias("shared"))
    return runs.join(shared, "run", "left").select("item", "run", "tokens", "begins", "ends", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def seeds(ids: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows of one mask whose counting tokens are all known (not 0)."""
    kept = [k for k, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(ids) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, ok = np.full(n, mask + 1, np.uint64), np.ones(n, bool)
    for k, f in zip(kept, _FACTORS):
        part = ids[k : k + n]
        ok &= part != 0
        h = (h ^ (part * f)) * _FACTORS[4]
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(ok)
    return h[at], at


def _figure(w: str) -> bool:
    return not w.isalpha()


def _extend(item: tuple[str, ...], doc: list[str], i: int, j: int, step: int) -> tuple[int, int, int, int, bool]:
    """Words and figures matched from (i, j) on in one direction, the last matched positions, and whether another figure stopped it."""
    n = figures = 0
    end_i, end_j, slack, conflict = i - step, j - step, 4.0, False
    while 0 <= i < len(item) and 0 <= j < len(doc):
        if same_word(item[i], doc[j]):
            n += 1
            figures += _figure(item[i])
            end_i, end_j, slack = i, j, min(4.0, slack + 0.5)
            i, j = i + step, j + step
            continue
        if _figure(item[i]) and _figure(doc[j]):
            ahead = [(i + k * step, j + k * step) for k in (1, 2, 3)]
            ahead = [same_word(item[x], doc[y]) for x, y in ahead if 0 <= x < len(item) and 0 <= y < len(doc)]
            conflict = bool(ahead) and sum(ahead) >= min(2, len(ahead))  # the sentence goes on alike: it is another one
            break
        found = None
        for a, b in ((1, 1), (0, 1), (1, 0), (0, 2), (1, 2), (2, 1), (0, 3), (2, 2), (1, 3), (0, 4), (3, 3)):
            x, y = i + a * step, j + b * step
            if not (0 <= x < len(item) and 0 <= y < len(doc)) or not same_word(item[x], doc[y]):
                continue
            if any(_figure(item[i + k * step]) for k in range(a)) or any(_figure(doc[j + k * step]) for k in range(b)):
                continue
            x2, y2 = x + step, y + step
            if 0 <= x2 < len(item) and 0 <= y2 < len(doc) and not same_word(item[x2], doc[y2]) and not (_figure(item[x]) or len(item[x]) > 4):
                continue  # one short word alone says little
            found = a, b
            break
        if found is None:
            break
        slack -= max(found) * (1.0 if found[0] else 0.5)
        if slack < 0:
            break
        i, j = i + found[0] * step, j + found[1] * step
    return n, figures, end_i, end_j, conflict


def _goes_on(item: tuple[str, ...], doc: list[str], i: int, j: int, step: int) -> bool:
    """Whether the item has a figure within ``NEAR`` words behind the end of a stretch and the document other ones there."""
    figures = lambda w, at: {w[x] for k in range(1, NEAR + 1) if 0 <= (x := at + k * step) < len(w) and _figure(w[x])}
    mine, other = figures(item, i), figures(doc, j)
    return bool(mine and other) and not mine & other


def leaks(runs: Runs, n: int, doc: list[str], hits: list[tuple[int, int]]) -> bool:
    """Whether the document holds a passage of run ``n``, given where seeds hit (position in run, position in document)."""
    run = runs.runs[n]
    item, spans = run.tokens, run.spans
    done: list[tuple[int, int, int, int]] = []
    for i, j in hits:
        if any(a <= i <= b and c <= j <= d for a, b, c, d in done):
            continue
        right, fr, ri, rj, cr = _extend(item, doc, i, j, 1)
        left, fl, li, lj, cl = _extend(item, doc, i - 1, j - 1, -1)
        done.append((li, ri, lj, rj))
        n_words, figures = right + left, fr + fl
        if n_words >= STRETCH and not (cr or cl):
            if figures >= FIGURES:
                return True
            if not (_goes_on(item, doc, ri, rj, 1) or _goes_on(item, doc, li, lj, -1) or any(k in run.shared for k in range(li, ri + 2 - STRETCH))):
                return True
        share = n_words / (ri - li + 1)
        for a, b in spans:  # another figure may follow a whole sentence
            if b - a >= 5 and li <= a + (b - a) * (1 - WHOLE) / 2 and ri >= b - 1 - (b - a) * (1 - WHOLE) / 2 and share >= 0.6:
                if not any(_figure(w) for w in (*item[a : max(a, li)], *item[min(b, ri + 1) : b])):
                    return True
    return False


def search(runs: Runs, texts: list[str | None]) -> list[tuple[int, int]]:
    """(row, item) for the texts that hold a passage of an item."""
    docs, ids, start = [], [], []
    get = runs.ids.get
    for t in texts:
        w = words(fold(t)) if t else []
        docs.append(w)
        start.append(len(ids))
        ids += [get(x, 0) for x in w]
        ids += [0] * 8
    if not ids or not len(runs.hashes):
        return []
    flat, begin = np.array(ids, np.uint64), np.array(start)
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for m in range(len(MASKS)):
        h, at = seeds(flat, m)
        lo = np.searchsorted(runs.hashes, h, "left")
        hi = np.searchsorted(runs.hashes, h, "right")
        hit = np.flatnonzero(hi > lo)
        rows = np.searchsorted(begin, at[hit], "right") - 1
        for k, row in zip(hit.tolist(), rows.tolist()):
            j = int(at[k]) - start[row]
            for n, i in runs.places[lo[k] : hi[k]].tolist():
                hits[row, n].append((i, j))
    out = []
    for (row, n), places in hits.items():
        if leaks(runs, n, docs[row], sorted(set(places))):
            out.append((row, runs.runs[n].item))
    return sorted(set(out))


def leaked_documents(
    spark: SparkSession, items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (item_id, doc_id) per document that holds a passage of an item.

    Nulls and empty texts hold nothing and leak nothing; rows with a null id are left out.  Repeated items or documents
    give one row per pair of ids.  No items or no documents give no rows.  Other columns are ignored.
    """
    rows = items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct()
    corpus = documents.select(doc_id, text).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    schema = f"{item_id} {items.schema[item_id].dataType.simpleString()}, {doc_id} {documents.schema[doc_id].dataType.simpleString()}"
    found, kind = spark.createDataFrame([], schema), _arrow(items, item_id)

    def one(block: list[Run]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)  # BLOCK tokens and one item at most

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = Runs(shipped.value)
            for batch in batches:
                pairs = search(runs, batch.column(text).to_pylist())
                docs = batch.column(doc_id).take(pa.array([r for r, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in pairs], kind), docs], names=[item_id, doc_id])

        return corpus.mapInArrow(run, schema)

    block: list[Run] = []
    held = 0
    prepared = prepared_runs(spark, rows, item_id, text)
    for r in prepared.orderBy("run").toLocalIterator():  # blocks of a stated query set against all rows
        block.append(Run(r["item"], tuple(r["tokens"]), list(zip(r["begins"], r["ends"])), frozenset(r["shared"])))
        held += len(r["tokens"])
        if held >= BLOCK:
            found, block, held = found.union(one(block)), [], 0
    if block:
        found = found.union(one(block))
    return found.distinct()


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
