"""Wordings learned from the table itself: remarks that ask for nothing, and words that mean the same.

Two requests on one source model that hold the same figures and identifiers mostly ask for the same edit, so what differs between them
tells how people vary their words.  Pairs of such requests are aligned, segment by segment and then word by word:

* a phrase that comes and goes between them is a remark, one that stays is part of what is asked;
* phrases that take each other's place mean the same, unless they are opposites (left and right, north and south, first and second),
  which is what the few requests among them differ by that ask for something else.

Only shares of the aligned pairs decide, so the result does not depend on the size of the table.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.session import stage_table

Phrase = tuple[str, ...]
Segments = list[Phrase]

# Closed classes of English words whose members exclude each other.  Each family lists its members, each member its words.
CONTRASTS = (
    ("north northern northwards", "south southern southwards", "east eastern eastwards", "west western westwards"),
    ("left", "right"),
    ("above over up upper top higher highest", "below under beneath down lower lowest bottom"),
    ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "last"),
    ("start beginning", "end", "middle midway centre center"),
    ("front", "back rear behind"),
    ("inside inner internal", "outside outer external"),
    ("before", "after"),
    ("more", "less fewer"),
    ("nearest closest", "farthest furthest"),
    ("towards toward", "away"),
    ("with", "without"),
    ("not never no",),
    ("high height tall", "wide width", "long length", "thick thickness", "deep depth"),
    ("horizontal horizontally", "vertical vertically"),
    ("clockwise", "anticlockwise counterclockwise"),
)
_MEMBER = {w: (f, m) for f, family in enumerate(CONTRASTS) for m, words in enumerate(family) for w in words.split()}
#: Share of the aligned pairs that hold a phrase from which on it counts as coming and going.
COMES_AND_GOES = 0.15
#: Share of the pairs that hold the rarer of two phrases from which on these take each other's place.
SWAPS = 0.05
#: Aligned pairs that must show a phrase, at least (a single record is in two), and one in so many of all pairs.
LEAST_PAIRS, ONE_PAIR_IN = 3, 20_000
#: Words of the longest phrase within a segment.
LONGEST = 6


def is_word(token: str) -> bool:
    return token[0].isalpha()


def members(phrase: Iterable[str]) -> dict[int, set[int]]:
    """Family to members of the contrasting words of a phrase."""
    out: dict[int, set[int]] = {}
    for w in phrase:
        if w in _MEMBER:
            out.setdefault(_MEMBER[w][0], set()).add(_MEMBER[w][1])
    return out


@dataclass
class Wordings:
    """What was learned. rewrites: phrase to the phrase it is read as (empty for a remark). asking: segments that stay."""

    rewrites: dict[Phrase, Phrase] = field(default_factory=dict)
    asking: frozenset[Phrase] = frozenset()

    def __post_init__(self) -> None:
        self._by_first: dict[str, list[Phrase]] = {}
        for p in self.rewrites:
            self._by_first.setdefault(p[0], []).append(p)
        for ps in self._by_first.values():
            ps.sort(key=len, reverse=True)
        for p, to in self.rewrites.items():  # what a phrase is read as may hold phrases itself
            self.rewrites[p] = self.segment(to) if p != to else to

    def segment(self, tokens: Phrase) -> Phrase:
        """A segment with its phrases rewritten, from left to right, long ones first."""
        by_first = self._by_first
        if not any(t in by_first for t in tokens):
            return tokens
        out: list[str] = []
        i = 0
        while i < len(tokens):
            for p in by_first.get(tokens[i], ()):
                if tokens[i : i + len(p)] == p:
                    out += self.rewrites[p]
                    i += len(p)
                    break
            else:
                out.append(tokens[i])
                i += 1
        return tuple(out)

    def __call__(self, segments: Segments) -> Segments:
        return [s for x in segments if (s := self.segment(x))]


def differences(a: Segments, b: Segments) -> tuple[list[Phrase], list[tuple[Phrase, Phrase]]]:
    """Phrases without figures that only one of two requests holds, and phrases that take each other's place."""
    x, y = Counter(a), Counter(b)
    rest_a, rest_b = list((x - y).elements()), list((y - x).elements())
    alone: list[Phrase] = []
    swapped: list[tuple[Phrase, Phrase]] = []
    for s in rest_a:
        mine = set(s)
        shared = [len(mine & set(u)) / min(len(mine), len(set(u))) for u in rest_b]
        best = max(range(len(rest_b)), key=lambda k: shared[k], default=None)
        if best is None or shared[best] < 0.5:
            alone.append(s)
            continue
        u = rest_b.pop(best)
        for tag, i, k, j, n in difflib.SequenceMatcher(None, s, u, autojunk=False).get_opcodes():
            if tag in ("insert", "delete"):
                alone.append(s[i:k] or u[j:n])
            elif tag == "replace":
                swapped.append((min(s[i:k], u[j:n]), max(s[i:k], u[j:n])))
    alone += rest_b
    words = lambda p: all(map(is_word, p))
    return [p for p in alone if words(p)], [(p, q) for p, q in swapped if words(p) and words(q) and max(len(p), len(q)) <= LONGEST]


def _runs(segments: Segments, most: int = LONGEST) -> set[Phrase]:
    """Phrases of up to ``most`` words without figures, and whole segments without figures."""
    out: set[Phrase] = set()
    for s in segments:
        for i in range(len(s)):
            for n in range(1, most + 1):
                if i + n > len(s) or not is_word(s[i + n - 1]):
                    break
                out.add(s[i : i + n])
        if len(s) > most and all(map(is_word, s)):
            out.add(s)
    return out


def split(form: str) -> Segments:
    return [tuple(s.split(" ")) for s in form.split(" ; ")] if form else []


def join(phrase: Phrase) -> str:
    return " ".join(phrase)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Segments, Segments]]:
    """Neighbouring rows of one block (rows come sorted by block)."""
    at = before = None
    for batch in batches:
        for block, form in zip(batch.column("learn").to_pylist(), batch.column("form").to_pylist()):
            now = split(form)
            if block == at:
                yield before, now
            at, before = block, now


def _counted(counts: Counter, schema: list[str]) -> pa.RecordBatch:
    columns = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * len(schema)
    kinds = [pa.string()] * (len(schema) - 1) + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema)


def learn(spark: SparkSession, forms: DataFrame) -> Wordings:
    """``forms`` has ``learn``, a hash of what two requests must share to be aligned (or null), and ``form``, segments joined by " ; ".

    Nulls and forms that no other request is aligned with teach nothing; no forms give no wordings.  What comes to the driver are
    phrases of at least one in ``ONE_PAIR_IN`` of the aligned pairs; a pair differs in few of them, so their number has a bound.
    """
    rows = forms.where(F.col("learn").isNotNull()).select("learn", "form", F.xxhash64("form").alias("spot"))
    varied = rows.groupBy("learn").agg(F.min("spot").alias("a"), F.max("spot").alias("b")).where("a <> b").select("learn")
    near = rows.join(varied, "learn", "left_semi").dropDuplicates(["learn", "spot"])
    # ranges of (block, hash): a block with very many wordings is cut, and only the pairs across the cuts are not looked at
    near = stage_table(spark, near, "aligned")
    ordered = near.repartitionByRange("learn", "spot").sortWithinPartitions("learn", "spot").select("learn", "form")

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for a, b in _pairs(batches):
            counts["pair", ""] += 1
            counts.update({("alone", join(p)) for p in differences(a, b)[0]})
        yield _counted(counts, ["kind", "phrase", "n"])

    seen = stage_table(spark, ordered.mapInArrow(alone, "kind string, phrase string, n long").groupBy("kind", "phrase").agg(F.sum("n").alias("n")), "alone")
    n_pairs = seen.where("kind = 'pair'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not n_pairs:
        return Wordings()
    least = max(LEAST_PAIRS, n_pairs // ONE_PAIR_IN)
    gone = {tuple(r["phrase"].split(" ")): r["n"] for r in seen.where((F.col("kind") == "alone") & (F.col("n") >= least)).collect()}
    without = Wordings(dict.fromkeys(gone, ()))

    def swapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for a, b in _pairs(batches):
            both = _runs(a) & _runs(b)
            counts.update({("kept", join(p), "") for p in both})
            counts.update({("whole", join(p), "") for p in set(a) & set(b) if all(map(is_word, p))})
            counts.update({("swap", join(p), join(q)) for p, q in differences(without(a), without(b))[1]})
        yield _counted(counts, ["kind", "phrase", "other", "n"])

    told = ordered.mapInArrow(swapped, "kind string, phrase string, other string, n long").groupBy("kind", "phrase", "other").agg(F.sum("n").alias("n"))
    told = stage_table(spark, told, "swaps")
    swaps = {(tuple(r["phrase"].split(" ")), tuple(r["other"].split(" "))): r["n"] for r in told.where((F.col("kind") == "swap") & (F.col("n") >= least)).collect()}
    wanted = {join(p) for p in gone} | {join(p) for pair in swaps for p in pair}
    names = spark.createDataFrame([(p,) for p in sorted(wanted)], "phrase string")  # phrases just counted above
    kept = {tuple(r["phrase"].split(" ")): r["n"] for r in told.where("kind = 'kept'").join(names, "phrase", "left_semi").collect()}
    whole = {tuple(r["phrase"].split(" ")): r["n"] for r in told.where((F.col("kind") == "whole") & (F.col("n") >= least)).collect()}
    return decide(gone, swaps, kept, whole)


def decide(gone: dict[Phrase, int], swaps: dict[tuple[Phrase, Phrase], int], kept: dict[Phrase, int], whole: dict[Phrase, int]) -> Wordings:
    """Wordings from counts of pairs: where a phrase stands alone, where two take each other's place, where both requests hold a phrase."""
    comes = {p for p, n in gone.items() if n >= COMES_AND_GOES * (n + kept.get(p, 0)) and (len(p) > 2 or not members(p))}
    rewrites: dict[Phrase, Phrase] = dict.fromkeys(comes, ())
    parent: dict[Phrase, Phrase] = {}

    def root(p: Phrase) -> Phrase:
        while parent.setdefault(p, p) != p:
            p = parent[p]
        return p

    held: dict[Phrase, dict[int, set[int]]] = {}
    for (p, q), n in sorted(swaps.items(), key=lambda x: (-x[1], x[0])):
        if p in comes or q in comes or n < SWAPS * (n + min(kept.get(p, 0), kept.get(q, 0))) or _slip(p, q):
            continue
        a, b = root(p), root(q)
        x, y = held.get(a, members(a)), held.get(b, members(b))
        if a == b or any(x[f] != y[f] for f in x.keys() & y.keys()):
            continue  # opposites never come into one class, not even through others
        a, b = sorted((a, b), key=lambda r: (-kept.get(r, 0), len(r), r))
        parent[b] = a
        held[a] = {f: x.get(f, set()) | y.get(f, set()) for f in x.keys() | y.keys()}
    for p in list(parent):
        if root(p) != p:
            rewrites[p] = root(p)
    asking = frozenset(p for p, n in whole.items() if p not in comes and gone.get(p, 0) < COMES_AND_GOES * (n + gone.get(p, 0)))
    return Wordings(rewrites, asking)


def _slip(p: Phrase, q: Phrase) -> bool:
    """Whether two phrases differ by spelling alone, which is put right elsewhere."""
    if len(p) != len(q):
        return False
    return all(a == b or (min(len(a), len(b)) >= 4 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8) for a, b in zip(p, q))
