"""Requests in canonical form: the same edit in other words, units or order reads the same.

A request is lower-cased and cut into tokens (identifiers, numbers, words); lengths become tenths of a millimetre; misspelt words are
put right against words that are far more frequent in the table; wordings learned from the table (``wordings.py``) take one form and remarks
that ask for nothing go; sentences are sorted.  Two records of one source model whose canonical forms hold the same figures and
words, but for slips and remarks that were not learned, ask for the same edit.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.llm.wordings import Segments, Wordings, is_word, join, learn, members, split
from spanwork.session import stage_table

#: Words in one of so many records are counted, and words in one of so many (and three at least) are established: no slip is that frequent.
COUNTED_ONE_IN, ESTABLISHED_ONE_IN = 20_000, 2_000
#: A word is a slip of an established one only if that is so many times as frequent.
RATIO = 20
#: Words of a shingle and similarity of near requests.
WIDTH, THRESHOLD = 5, 0.8

_HIDDEN = re.compile("[​-‏⁠﻿­]")
_ID = r"(?<![0-9a-z_$])[0-3][0-9a-z_$]{21}(?![0-9a-z_$])"
_UNIT = r"mm|cm|m|(?:milli|centi)?met(?:re|er)s?|ft|feet|foot|inch(?:es)?"
_TOKEN = re.compile(rf"{_ID}|(?<![^\W_])[^\W\d_]{{1,3}}-\d+|\d+(?:[.,]\d+)?(?:\s*(?:{_UNIT})(?![a-z0-9]))?|[^\W\d_]+|[.!?\n]|:(?=\s+[^\W\d#])")
_NUMBER = re.compile(r"(\d+)(?:[.,](\d+))?\s*([a-z]*)")
_TENTHS = {"mm": 10, "cm": 100, "m": 10_000, "mi": 10, "ce": 100, "me": 10_000, "ft": 3048, "fe": 3048, "fo": 3048, "in": 254}
_ENDS = frozenset(".!?\n:")


def _number(token: str) -> str:
    whole, part, unit = _NUMBER.match(token).groups()
    if not unit:
        part = (part or "").rstrip("0")
        return f"{int(whole)}.{part}" if part else str(int(whole))
    scale = _TENTHS.get(unit) or _TENTHS[unit[:2]]
    return f"#{round(float(f'{whole}.{part or 0}') * scale)}"


def segments(text: str) -> Segments:
    """Sentences and what ends in a colon, each as tokens: identifiers as they are, lengths as ``#`` and tenths of a millimetre, other
    numbers without trailing zeros, sheet codes such as a-204, and words."""
    out: list[list[str]] = [[]]
    for t in _TOKEN.findall(_HIDDEN.sub("", text).lower().replace(" ", " ")):
        c = t[0]
        if c in _ENDS:
            if out[-1]:
                out.append([])
        elif c.isdigit():
            out[-1].append(t if len(t) == 22 and not t.isdigit() and " " not in t and re.fullmatch(_ID, t) else _number(t))
        else:
            out[-1].append(t)
    return [tuple(s) for s in out if s]


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, exchange, swap of neighbours) between two words, or ``most + 1`` where they are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _shorter(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@dataclass
class Words:
    """Counts of words by record, of those in one of ``COUNTED_ONE_IN`` records, and the count from which a word is established."""

    counts: dict[str, int]
    least: int

    def __post_init__(self) -> None:
        self._near: dict[str, list[str]] = defaultdict(list)
        for w, n in self.counts.items():
            if n >= self.least and len(w) >= 4:
                for x in _shorter(w, 2):
                    self._near[x].append(w)
        self.right = lru_cache(200_000)(self._right)

    def __getstate__(self) -> tuple:
        return self.counts, self.least

    def __setstate__(self, state: tuple) -> None:
        self.counts, self.least = state
        self.__post_init__()

    def established(self, word: str) -> bool:
        return self.counts.get(word, 0) >= self.least

    def slip(self, word: str, other: str) -> bool:
        """Whether one of the two may be a slip of the other, which is established and far more frequent."""
        if not (word.isalpha() and other.isalpha()) or min(len(word), len(other)) < 3:
            return False
        a, b = sorted((self.counts.get(word, 1), self.counts.get(other, 1)))
        return a < self.least and (b >= RATIO * a or b < self.least) and distance(word, other, 2) <= (2 if min(len(word), len(other)) > 4 else 1)

    def _right(self, word: str) -> str:
        """The established word that ``word`` is a slip of, else the word itself.  Lost, doubled and swapped letters go
        before exchanged ones, one slip before two, frequent words before rare ones."""
        n_own = self.counts.get(word, 1)
        if n_own >= self.least or len(word) < 4 or not word.isalpha():
            return word
        best = None
        for other in {w for x in _shorter(word, 2) for w in self._near.get(x, ())}:
            n = self.counts[other]
            if n < RATIO * n_own:
                continue
            d = distance(word, other, 2)
            if d == 1 or d == 2 and len(word) >= 5:
                exchanged = len(word) == len(other) and sorted(word) != sorted(other)
                best = min(best or (9,), (d, exchanged, -n, other))
        return best[3] if best else word


def known_words(texts: DataFrame, column: str) -> Words:
    """Words and the number of records that hold them, for words in at least one of ``COUNTED_ONE_IN`` records.

    One record adds at most its distinct words to the sum of counts, so the result has at most ``COUNTED_ONE_IN`` times
    the mean number of distinct words of a record, whatever the size of the table.
    """
    total = texts.count()
    words = F.explode(F.array_distinct(F.split(F.lower(F.col(column)), r"[^\p{L}]+"))).alias("word")
    counts = texts.select(words).groupBy("word").count().where((F.col("count") >= max(1, total // COUNTED_ONE_IN)) & (F.length("word") > 0))
    return Words({r["word"]: r["count"] for r in counts.collect()}, max(3, total // ESTABLISHED_ONE_IN))


def canonical(parts: Segments, wordings: Wordings) -> str:
    return " ; ".join(sorted(map(join, wordings(parts))))


def figures(parts: Segments) -> str:
    """All figures and identifiers in order of size: slips do not touch them."""
    return " ".join(sorted(t for s in parts for t in s if not is_word(t)))


def shingles(form: str, width: int = WIDTH) -> set[str]:
    """Runs of ``width`` words within a sentence; a shorter sentence is one run."""
    out = set()
    for sentence in form.split(" ; "):
        t = sentence.split(" ")
        out.update(" ".join(t[i : i + width]) for i in range(max(1, len(t) - width + 1)))
    return out


def similarity(a: str, b: str, width: int = WIDTH) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y)


def same_edit(a: str, b: str, words: Words, wordings: Wordings) -> bool:
    """Whether two canonical forms hold the same figures and words.  Words may differ by slips; a segment without figures and contrasts that
    only one form holds and that is like none of the other is a remark, unless it was learned to be part of what is asked."""
    if a == b:
        return True
    mine, other = split(a), split(b)
    x, y = Counter(t for s in mine for t in s), Counter(t for s in other for t in s)
    only_a, only_b = x - y, y - x
    if any(not is_word(t) for t in (*only_a, *only_b)):
        return False
    for t in list(only_a):
        for u in sorted(only_b, key=lambda u: distance(t, u, 2)):
            if only_a[t] and only_b[u] and words.slip(t, u):
                n = min(only_a[t], only_b[u])
                only_a[t] -= n
                only_b[u] -= n
    for left, own, theirs in ((+only_a, mine, other), (+only_b, other, mine)):
        if left and not _remarks(left, own, theirs, wordings):
            return False
    return True


def _remarks(left: Counter, own: Segments, theirs: Segments, wordings: Wordings) -> bool:
    """Whether the words that only one form holds come from remarks of it."""
    there = set(theirs)
    for s in own:
        if s in there or s in wordings.asking or members(s) or not all(map(is_word, s)):
            continue
        bag, mine = Counter(s), set(s)
        if sum((bag & left).values()) * 2 > len(s) and all(len(mine & set(u)) * 2 < min(len(mine), len(set(u))) for u in theirs):
            left = left - bag
    return not left


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _flat(forms: list[str], pad: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens (the first is the pad); for all tokens of all forms, each segment with ``pad`` pads behind it: number of the
    token, row, place within its segment, length of its segment."""
    ids: dict[str, int] = {"": 0}
    flat: list[int] = []
    n_segments: list[int] = []
    sizes: list[int] = []
    for form in forms:
        own = form.split(" ; ")
        n_segments.append(len(own))
        for s in own:
            tokens = s.split(" ")
            sizes.append(len(tokens))
            flat += [ids.setdefault(t, len(ids)) for t in tokens]
            flat += [0] * pad
    size = np.array(sizes, np.int64)
    row = np.repeat(np.repeat(np.arange(len(forms)), n_segments), size + pad)
    begin = np.cumsum(size + pad) - (size + pad)
    place = np.arange(len(flat)) - np.repeat(begin, size + pad)
    return list(ids), np.array(flat, np.int64), row, place, np.repeat(size, size + pad)


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)


def fingerprints_of(forms: list[str]) -> list[int]:
    """64 bits of which each is the majority vote of the tokens' hashes.  A figure or identifier outvotes the words, which
    together weigh as much as a fiftieth of one, and no two weigh quite the same: so texts with the same figures have close ones."""
    out: list[int] = []
    for k in range(0, len(forms), 500):
        tokens, flat, row, _, _ = _flat(forms[k : k + 500], 0)
        h = _hashes(tokens)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.float32) * 2 - 1
        word = np.array([not t or is_word(t) for t in tokens])
        n = np.bincount(row, word[flat], minlength=row[-1] + 1)
        weight = np.where(word[flat], 0.02 / np.sqrt(np.maximum(n, 1))[row], (1 + (h & np.uint64(1023)).astype(float) / 2048)[flat])
        begin = np.searchsorted(row, np.arange(row[-1] + 1))
        votes = np.add.reduceat(bits[flat] * weight.astype(np.float32)[:, None], begin)
        out += np.packbits(votes > 0, axis=1).view(">i8").ravel().astype(np.int64).tolist()
    return out


def prefixes_of(forms: list[str], words: Words, width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of shingles of each form, and the hashes of its prefix in global order: by the count of the rarest token, then by hash.

    Sets whose similarity is at least ``threshold`` share a shingle of their prefixes, which hold n - ceil(threshold n) + 1 of n.
    """
    if not forms:
        return np.zeros(0, np.int64), []
    tokens, flat, row, place, size = _flat(forms, width - 1)
    h = _hashes(tokens)
    h[0] = 0
    count = np.array([words.counts.get(t, 0) if t and is_word(t) else 0 for t in tokens], np.int64)
    count[0] = np.iinfo(np.int64).max
    start = np.flatnonzero(place < np.maximum(1, size - width + 1))
    mixed, rare = np.zeros(len(start), np.uint64), np.full(len(start), np.iinfo(np.int64).max)
    for k in range(width):
        at = flat[start + k]
        mixed = (mixed ^ h[at]) * _FACTORS[k % len(_FACTORS)]
        mixed ^= mixed >> np.uint64(29)
        rare = np.minimum(rare, count[at])
    order = np.lexsort((mixed, rare, row[start]))
    r, c, m = row[start][order], rare[order], mixed[order].view(np.int64)
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])])
    r, m = r[new], m[new]
    n = np.bincount(r, minlength=len(forms))
    begin = np.cumsum(n) - n
    first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    return n, [m[b : b + f] for b, f in zip(begin.tolist(), first.tolist())]


@dataclass
class Requests:
    """rows: rec_id, loaded_at, split, extra columns, block, fig, hi, lo, canonical and made columns, one per delivered row."""

    rows: DataFrame
    words: Words
    wordings: Wordings

    def members(self, extra: tuple[str, ...] = ()) -> DataFrame:
        """The latest delivery of each record, if it has a split, a source model and a text."""
        names = ["split", *extra, "block", "hi", "lo"]
        best = F.max_by(F.struct(*names), F.col("loaded_at")).alias("r")
        rows = self.rows.where(F.col("rec_id").isNotNull()).groupBy("rec_id").agg(best).select("rec_id", "r.*")
        return rows.where(F.col("split").isNotNull() & F.col("block").isNotNull())


def requests_table(spark: SparkSession, task: DataFrame, extra: tuple[str, ...] = (), prefixes: bool = False, fingerprints: bool = False) -> Requests:
    """``block`` hashes the source model, ``fig`` the figures; ``hi`` and ``lo`` hash source model and canonical form.  All are null
    for a row without model or text, which is kept because it may replace an earlier delivery.

    ``prefixes`` adds ``n`` and ``prefix``, the number of shingles and the hashes of the first in global order; ``fingerprints`` adds ``print``.
    The tables are written to the shared folder: later steps read only their narrow columns.
    """
    source = task.select(
        "rec_id",
        "loaded_at",
        labels.split(F.col("split")).alias("split"),
        *extra,
        labels.model_key(F.col("input_ifc")).alias("model"),
        F.coalesce(F.col("prompt"), F.col("instruction")).alias("text"),
    )
    words = known_words(source, "text")
    fields = [f for f in source.schema.fields if f.name not in ("model", "text")]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = words.right
        for batch in batches:
            block, fig, learned, forms = [], [], [], []
            for model, text in zip(batch.column("model").to_pylist(), batch.column("text").to_pylist()):
                parts = segments(text) if model and text else []
                if not parts:
                    block.append(None), fig.append(None), learned.append(None), forms.append(None)
                    continue
                parts = [tuple(right(t) if t[0].isalpha() else t for t in s) for s in parts]
                own = figures(parts)
                block.append(_signed(xxhash.xxh64_intdigest(model)))
                fig.append(_signed(xxhash.xxh64_intdigest(own)))
                learned.append(_signed(xxhash.xxh64_intdigest(f"{model}\n{own}")) if own else None)
                forms.append(" ; ".join(map(join, parts)))
            keep = [batch.column(f.name) for f in fields]
            made = [pa.array(c, pa.int64()) for c in (block, fig, learned)] + [pa.array(forms, pa.string())]
            yield pa.RecordBatch.from_arrays(keep + made, names=[f.name for f in fields] + ["block", "fig", "learn", "form"])

    tokens = stage_table(spark, source.mapInArrow(cut, f"{head}, block long, fig long, learn long, form string"), "tokens")
    wordings = learn(spark, tokens)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(split(f), wordings) if f else "" for f in batch.column("form").to_pylist()]
            at = [i for i, f in enumerate(forms) if f]  # the others are no request, or remarks alone
            there, texts = pa.array([bool(f) for f in forms], pa.bool_()), [forms[i] for i in at]
            both = [xxhash.xxh3_128_intdigest(f"{b}\n{t}") for b, t in zip(batch.column("block").take(pa.array(at, pa.int64())).to_pylist(), texts)]
            made = {"hi": [_signed(x >> 64) for x in both], "lo": [_signed(x & ((1 << 64) - 1)) for x in both], "canonical": texts}
            if prefixes:
                made["n"], made["prefix"] = prefixes_of(texts, words)
            if fingerprints:
                made["print"] = fingerprints_of(texts)
            spread = np.full(len(forms), -1)
            spread[at] = np.arange(len(at))
            spread = pa.array(spread, pa.int64(), mask=spread < 0)
            kinds = {"canonical": pa.string(), "n": pa.int32(), "prefix": pa.list_(pa.int64())}
            keep = [batch.column(f.name) for f in fields]
            keep += [pa.compute.if_else(there, batch.column(c), pa.nulls(batch.num_rows, pa.int64())) for c in ("block", "fig")]
            columns = [pa.array(c, kinds.get(k, pa.int64())).take(spread) for k, c in made.items()]
            yield pa.RecordBatch.from_arrays([*keep, *columns], names=[*[f.name for f in fields], "block", "fig", *made])

    wanted = ["hi", "lo", "canonical", *(["n", "prefix"] if prefixes else []), *(["print"] if fingerprints else [])]
    kinds = {"canonical": "string", "n": "int", "prefix": "array<long>"}
    schema = f"{head}, block long, fig long, " + ", ".join(f"{k} {kinds.get(k, 'long')}" for k in wanted)
    slim = tokens.select(*[f.name for f in fields], "block", "fig", "form")
    return Requests(stage_table(spark, slim.mapInArrow(read, schema), "canonical"), words, wordings)
