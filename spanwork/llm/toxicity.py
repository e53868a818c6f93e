"""Score documents for abuse, hate and sexual content by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples, all other text is unlabelled: it holds toxic text too, so it is no
negative class.  With the class prior ``p`` the risk of a scorer ``g`` is ``p R+(g) + max(0, Ru-(g) - p R+-(g))``; the second
term estimates the risk on clean text and is kept from going below zero, where it would only reward learning the
examples by heart.  The scorer is linear over hashed words, word pairs and letter groups of one sentence, trained with numpy.

A toxic document is mostly clean sentences.  The first round takes all its sentences as positive, which already ranks what toxic
documents have and the corpus as a whole has not; the next rounds keep of each toxic document only the sentences
that score like it.  A document's score is that of its worst sentence.

Where to flag is decided by the same risk, for documents and with the loss of a yes or no: missed positives weigh the class prior, flagged
documents beyond what the prior explains weigh as false alarms.  Documents are scored for it by models that have not seen their own
label (``FOLDS``), because a model ranks its own examples too high.  What reviewers found clean is not used.

Scale: only the weights are fitted on at most ``MAX_LABELLED`` labelled and ``MAX_UNLABELLED`` other documents, chosen by the hash of
their ids, on the driver; each weighs as many documents as it stands for.  How often units occur, the class prior, the first cut and
the threshold come from all documents: units are counted once by aggregation, and histograms of scores, of fixed size, come to the driver.
Scoring reads every document whole, in a map without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.fold import fold
from spanwork.session import stage_table

MAX_LABELLED = 10_000
MAX_UNLABELLED = 10_000
#: Words of one unit that is scored, share of all units and least score for positive examples.
WINDOW, KEPT, MARGIN = 16, 0.02, -1.0
#: A unit in so many documents is an example only if confirmed documents hold it so many times as often as all documents do.
FREQUENT, LIFT = 5, 3.0
#: Steps of the last fit; the earlier ones take a third.
STEPS = 450
#: Models that score the documents whose labels they have not seen.
FOLDS = 4
#: Buckets of the feature hash.
BUCKETS = 1 << 18
#: Bins of the histograms of scores: this many for each step of 1, and scores to both sides.
BINS, REACH = 128, 128

# Figures and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
_LEET = str.maketrans(LEET)
_SPACED = re.compile(r"(?<![\w@$!])(?:[\w@$!]([ ._\-*|])(?:[\w@$!]\1)+[\w@$!])(?![\w@$])")
_SEPARATOR = re.compile(r"[ ._\-*|]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile(r"[^\W_][\w@$!#*'’€]*|[@$][\w@$!#*]+")
_RUN = re.compile(r"(.)\1+")
_TURN = re.compile(r"(?<=[^\W\d])(?=\d)|(?<=\d)(?=[^\W\d])")
_DIGITS = re.compile(r"\d{4,}")


def _is_code(token: str) -> bool:
    """A mark such as a204, 2x3 or 12th rather than a word in which figures stand for letters: few letters, one change between
    letters and figures, or a long number inside."""
    letters = sum(map(str.isalpha, token))
    return token.isalnum() and (letters < 2 or len(_TURN.findall(token)) < 2 or _DIGITS.search(token) is not None)


@lru_cache(200_000)
def plain(token: str) -> str:
    """A token without disguise: letters for look-alike figures and signs, one letter for a run, ``0`` for a number."""
    t = token.rstrip("!*'’#")
    if t.isalpha():
        return _RUN.sub(r"\1", t)
    if not t or t.isdigit():
        return "0"
    if any(c in "*#" for c in t[1:-1]) or "@!" in t or "#@" in t:
        return f"{t[0]}*{t[-1] if t[-1].isalpha() else ''}"  # letters left out
    if _is_code(t):
        return "x0"
    return _RUN.sub(r"\1", t.translate(_LEET))


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence, disguises undone."""
    t = _SPACED.sub(lambda m: _SEPARATOR.sub("", m[0]) if sum(c.isalpha() for c in m[0]) > 1 else m[0], fold(text))
    out = []
    for s in _SENTENCE.split(t):
        tokens = [plain(w) for w in _TOKEN.findall(s)]
        if tokens:
            out.append(tokens)
    return out


def units(text: str | None) -> list[list[str]]:
    """Sentences; a longer one as windows that overlap by half, so that no neighbour dilutes what is scored."""
    out = []
    for s in sentences(text) if text else []:
        last = max(0, len(s) - WINDOW)
        out += [s[i : i + WINDOW] for i in range(0, last + WINDOW // 2, WINDOW // 2) if i == 0 or i < last + WINDOW // 2]
    return out


def features(tokens: list[str]) -> list[int]:
    """Buckets of words, pairs and triples of words, and groups of four letters, each once."""
    names = set(tokens)
    names.update(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))
    names.update(f"{a} {b} {c}" for a, b, c in zip(tokens, tokens[1:], tokens[2:]))
    for t in set(tokens):
        if len(t) > 3:
            w = f"^{t}$"
            names.update("~" + w[i : i + 4] for i in range(len(w) - 3))
    return sorted({xxhash.xxh32_intdigest(n) % BUCKETS for n in names})


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._cache: dict[tuple[str, ...], float] = {}

    def sentence(self, tokens: list[str]) -> float:
        key = tuple(tokens)
        g = self._cache.get(key)
        if g is None:
            f = features(tokens)
            g = float(self.weights[f].sum() / np.sqrt(len(f)) + self.bias)
            if len(self._cache) > 200_000:
                self._cache.clear()
            self._cache[key] = g
        return g

    def worst(self, text: str | None) -> float | None:
        """The score of the worst unit, None without words."""
        return max((self.sentence(s) for s in units(text)), default=None) if text else None

    def document(self, text: str | None) -> float:
        """Between 0 and 1; a text without words scores 0."""
        g = self.worst(text)
        return 0.0 if g is None else float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


class _Rows:
    """Sparse rows with weights, for sums over features by ``reduceat``."""

    def __init__(self, keys: list[tuple[str, ...]]) -> None:
        rows = [features(list(k)) for k in keys]
        self.size = np.array([len(r) for r in rows])
        self.flat = np.array([x for r in rows for x in r], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.scale = 1 / np.sqrt(self.size)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.add.reduceat(w[self.flat], self.start) * self.scale + b

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(g * self.scale, self.size), minlength=BUCKETS)


def fit_nnpu(rows: _Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, rate: float = 0.1, decay: float = 1e-6) -> Scorer:
    """Minimise the non-negative positive-unlabelled risk of the logistic loss by Adam on all rows.

    ``positive`` and ``unlabelled`` are how often each row occurs in either set.
    """
    p, u = positive / max(positive.sum(), 1e-9), unlabelled / max(unlabelled.sum(), 1e-9)
    w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        g = np.clip(rows.scores(w, b), -30, 30)
        toxic = 1 / (1 + np.exp(-g))
        loss = np.logaddexp(0, g)  # of calling a clean sentence toxic
        clean = float((u * loss).sum() - prior * (p * loss).sum())
        if clean >= 0:
            d = -prior * p * (1 - toxic) + (u - prior * p) * toxic
        else:
            d = -(u - prior * p) * toxic  # go back on what pushed the clean risk below zero
        gw, gb = rows.gradient(d) + decay * w, float(d.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return Scorer(w, b)


def class_prior(scores: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, least: float = 1e-4) -> float:
    """The share of positives in the unlabelled rows: at no threshold can more of them be above it than rows there are,
    so it is at most the least ratio of the two shares above a threshold, each with its sampling error."""
    order = np.argsort(-scores, kind="stable")
    n_p, n_u = max(positive.sum(), 1.0), max(unlabelled.sum(), 1.0)
    above_p, above_u = np.cumsum(positive[order]), np.cumsum(unlabelled[order])
    enough = above_p >= 0.2 * n_p
    if not enough.any():
        return least
    upper = (above_u + np.sqrt(above_u) + 1) / n_u
    lower = np.maximum(above_p - np.sqrt(above_p), 1e-9) / n_p
    return float(np.clip((upper / lower)[enough].min(), least, 0.5))


def score_bins(scores: np.ndarray) -> np.ndarray:
    """The bin of each score."""
    return np.clip(np.floor((np.asarray(scores, float) + REACH) * BINS), 0, 2 * REACH * BINS - 1).astype(np.int64)


def bin_scores() -> np.ndarray:
    """The score in the middle of each bin."""
    return (np.arange(2 * REACH * BINS) + 0.5) / BINS - REACH


def histogram(scores: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(score_bins(scores), counts, minlength=2 * REACH * BINS).astype(float)


def first_cut(counts: np.ndarray) -> float:
    """The score that the highest ``KEPT`` of all units reach, by a histogram of units."""
    falling = np.cumsum(counts[::-1])
    return float((len(counts) - 1 - np.searchsorted(falling, KEPT * falling[-1])) / BINS - REACH)


def flagged_share(everywhere: np.ndarray, confirmed: np.ndarray, width: float = 0.35, slack: float = 3.0) -> float:
    """The share of documents to flag, by histograms of scores of all documents and of confirmed ones.

    The risk at a threshold is ``p FN + max(0, U - p P)``: ``p`` the class prior, ``P`` and ``U`` the shares of confirmed and of all documents
    above it, ``FN = 1 - P``.  Reviewers err, so confirmed documents are taken as a mixture with the corpus; its part is read off the lower
    half of all scores, and taken out of ``P``.  Among thresholds whose risk is the least but for ``slack`` confirmed documents, the one
    where documents are rarest is taken.
    """
    n, k = everywhere.sum(), confirmed.sum()
    if not n or not k:
        return 0.0
    lower = np.cumsum(everywhere) <= n / 2
    err = min(0.9, confirmed[lower].sum() / k / max(everywhere[lower].sum() / n, 1e-9))
    held = k * (1 - err)
    above_u = np.cumsum(everywhere[::-1])[::-1] / n
    above_p = np.cumsum((confirmed - err * k * everywhere / n)[::-1])[::-1] / held
    enough = above_p >= 0.2
    prior = float(np.min(above_u[enough] / above_p[enough]))
    risk = prior * (1 - above_p) + np.maximum(0.0, above_u - prior * above_p)
    good = np.flatnonzero(risk <= risk.min() + slack * prior / held)
    reach = np.exp(-0.5 * (np.arange(-4 * BINS, 4 * BINS + 1) / BINS / width) ** 2)
    density = np.convolve(everywhere, reach, "same")
    best = good[density[good] <= density[good].min() + 1e-9]
    return float(above_u[best[len(best) // 2]])


def share_threshold(everywhere: np.ndarray, share: float) -> float:
    """The score above which a share of all documents lies, in the middle of the gap between documents if there is one."""
    above = np.cumsum(everywhere[::-1])[::-1]
    least = np.searchsorted(-above, -share * above[0] - 1e-9)  # the first bin from which on no more than the share lies
    filled = np.flatnonzero(everywhere[:least])
    low = int(filled[-1]) + 1 if len(filled) else int(least)
    return float((low + least) / 2 / BINS - REACH)


class Corpus:
    """What is taken from all documents, here from texts in memory with the share of reviewers who found each offensive (-1: none looked)."""

    def __init__(self, texts: list[str | None], share: np.ndarray) -> None:
        self.texts, self.share = texts, share
        self.n_docs, self.n_confirmed = len(texts), int((share > 0.5).sum())
        self._held: tuple[Counter, Counter] | None = None

    def _units(self) -> tuple[Counter, Counter]:
        if self._held is None:
            self._held = Counter(), Counter()
            for text, x in zip(self.texts, self.share):
                own = {tuple(k) for k in units(text)}
                self._held[0].update(own)
                if x > 0.5:
                    self._held[1].update(own)
        return self._held

    def held(self, keys: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each unit, and how many confirmed ones."""
        n, confirmed = self._units()
        return np.array([n[k] for k in keys], float), np.array([confirmed[k] for k in keys], float)

    def unit_scores(self, scorer: Scorer) -> np.ndarray:
        """Histogram of the scores of all units, each once per document."""
        n = self._units()[0]
        return histogram(np.array([scorer.sentence(k) for k in n]), np.array(list(n.values()), float))

    def document_scores(self, scorers: list[Scorer]) -> tuple[np.ndarray, np.ndarray]:
        """Histograms of the worst scores of all documents and of the confirmed ones, each document scored by the model of its fold."""
        worst = np.array([np.nan if (g := scorers[fold_of(t, len(scorers))].worst(t)) is None else g for t in self.texts], float)
        there = ~np.isnan(worst)
        return histogram(worst[there]), histogram(worst[there & (self.share > 0.5)])


def fold_of(text: str | None, folds: int) -> int:
    """The fold of a document; copies of a text share it."""
    return xxhash.xxh32_intdigest(text or "") % folds


def train(labelled: list[tuple[str | None, float]], unlabelled: list[str | None], rounds: int = 4, corpus: Corpus | None = None, stands_for: tuple[float, float] = (1.0, 1.0)) -> Scorer:
    """``labelled`` has a text and the share of its reviewers who found it offensive; above a half it is confirmed toxic, all
    other text is unlabelled: reviewers err, and what they looked at is no fair sample.

    The texts may be samples of ``corpus``; ``stands_for`` says for how many documents of it one of either list stands.

    After the first round each confirmed document keeps, as positive examples, its units among the highest ``KEPT`` of all,
    after the next ones those that score at least ``MARGIN``; never one that is as frequent elsewhere.
    """
    docs = [units(t) for t, _ in labelled] + [units(t) for t in unlabelled]
    share = np.array([x for _, x in labelled] + [-1.0] * len(unlabelled))
    keys = sorted({tuple(k) for d in docs for k in d})
    confirmed = np.flatnonzero(share > 0.5)
    if not keys or not len(confirmed):
        return Scorer(np.zeros(BUCKETS), -30.0)  # nothing confirmed
    corpus = corpus or Corpus([t for t, _ in labelled] + unlabelled, share)
    at = {k: i for i, k in enumerate(keys)}
    rows = _Rows(keys)
    index = [np.unique(np.array([at[tuple(k)] for k in d], np.int64)) for d in docs]  # each unit once per document
    weight = np.repeat(stands_for, [len(labelled), len(unlabelled)])
    u = np.bincount(np.concatenate(index), np.repeat(weight, [len(d) for d in index]), minlength=len(keys))

    own = [index[i] for i in confirmed]
    mine = np.unique(np.concatenate(own))
    if not len(mine):
        return Scorer(np.zeros(BUCKETS), -30.0)
    # what is frequent must also be more frequent in confirmed documents than in all
    u[mine], held = corpus.held([keys[i] for i in mine])
    likely = np.zeros(len(keys), bool)
    likely[mine] = (u[mine] < FREQUENT) | (held / np.maximum(u[mine], 1) >= LIFT * corpus.n_confirmed / corpus.n_docs)
    p = np.zeros(len(keys))
    for d in own:  # a document weighs 1, whatever its length
        p[d] += 1.0 / max(1, len(d))
    scorer, cut = fit_nnpu(rows, p, u, 0.3, STEPS // 3), None
    picked, prior = own, 0.3
    for last in [False] * (rounds - 1) + [True]:
        g = rows.scores(scorer.weights, scorer.bias)
        everywhere = corpus.unit_scores(scorer)
        if cut is None:  # the first scores have no scale, only an order
            cut = first_cut(everywhere)
        better = [d[(g[d] >= cut) & likely[d]] for d in own]
        if not sum(map(len, better)):
            break
        picked, p = better, _examples(better, len(keys))
        prior = class_prior(bin_scores(), histogram(g, p), everywhere)
        scorer, cut = fit_nnpu(rows, p, u, prior, STEPS if last else STEPS // 3), MARGIN
    fold = np.array([fold_of(labelled[i][0], FOLDS) for i in confirmed])
    unseen = [_examples([d for d, f in zip(picked, fold) if f != k], len(keys)) for k in range(FOLDS)]
    models = [fit_nnpu(rows, q, u, prior, STEPS // 3) if q.any() else scorer for q in unseen]
    share = flagged_share(*corpus.document_scores(models))
    return Scorer(scorer.weights, scorer.bias - share_threshold(corpus.document_scores([scorer])[0], share))


def _examples(picked: list[np.ndarray], size: int) -> np.ndarray:
    """How many of the documents hold each unit as an example."""
    p = np.zeros(size)
    for d in picked:
        p[d] += 1.0
    return p


def flag_threshold() -> float:
    """The least score of a flagged document."""
    return 0.5


def sample_by_hash(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About ``most`` rows of ``total``, the same at every run and whatever the partitions."""
    if total <= most:
        return df
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 11) / F.lit(float(1 << 53))
    return df.where(spot < most / total)


def _broadcast(spark: SparkSession, scorer: Scorer) -> Callable[[], Scorer]:
    """The scorer on the workers: at most BUCKETS numbers."""
    weights = np.flatnonzero(scorer.weights).astype(np.int32)
    shipped = spark.sparkContext.broadcast((weights, scorer.weights[weights].astype(np.float32), scorer.bias))

    def arrived() -> Scorer:
        at, values, bias = shipped.value
        w = np.zeros(BUCKETS)
        w[at] = values
        return Scorer(w, bias)

    return arrived


class _Tables(Corpus):
    """The same from tables. texts: doc_id, text. votes: doc_id, share."""

    def __init__(self, spark: SparkSession, texts: DataFrame, votes: DataFrame, n_docs: int, n_confirmed: int) -> None:
        self.spark, self.docs, self.votes, self.n_docs, self.n_confirmed = spark, texts, votes, n_docs, n_confirmed
        marked = texts.join(votes.where("share > 0.5").select("doc_id", F.lit(True).alias("confirmed")), "doc_id", "left")
        counted = marked.select("text", "confirmed").mapInArrow(_count_units, "unit string, n long, held long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
        self.units = stage_table(spark, counted, "units")

    def held(self, keys: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        names = [" ".join(k) for k in keys]
        wanted = self.spark.createDataFrame(pa.table({"unit": names}))  # units of the documents of the fit
        found = {r["unit"]: (r["n"], r["held"]) for r in self.units.join(wanted, "unit").collect()}
        n, confirmed = np.array([found[k] for k in names], float).T
        return n, confirmed

    def unit_scores(self, scorer: Scorer) -> np.ndarray:
        arrived = _broadcast(self.spark, scorer)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, counts = arrived(), np.zeros(2 * REACH * BINS)
            for batch in batches:
                if batch.num_rows:
                    g = np.array([mine.sentence(k.split(" ")) for k in batch.column("unit").to_pylist()])
                    counts += histogram(g, batch.column("n").to_numpy())
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], names=["bin", "n"])

        return _collected(self.units.select("unit", "n").mapInArrow(run, "bin long, n long"))

    def document_scores(self, scorers: list[Scorer]) -> tuple[np.ndarray, np.ndarray]:
        arrived = [_broadcast(self.spark, scorer) for scorer in scorers]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = [a() for a in arrived]
            for batch in batches:
                worst = [mine[fold_of(t, len(mine))].worst(t) for t in batch.column("text").to_pylist()]
                there = np.array([g is not None for g in worst], bool)
                at = score_bins(np.array([g for g in worst if g is not None], float))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(there)), pa.array(at, pa.int64())], names=["doc_id", "bin"])

        scored = self.docs.mapInArrow(run, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, bin long").join(self.votes, "doc_id", "left")
        rows = scored.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("share") > 0.5).alias("confirmed")).collect()  # at most one row a bin
        counts = np.zeros((2, 2 * REACH * BINS))
        for r in rows:
            counts[:, r["bin"]] = r["n"], r["confirmed"]
        return counts[0], counts[1]


def _count_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one batch that hold each unit."""
    for batch in batches:
        n: Counter[str] = Counter()
        held: Counter[str] = Counter()
        for text, confirmed in zip(batch.column("text").to_pylist(), batch.column("confirmed").to_pylist()):
            own = {" ".join(k) for k in units(text)}
            n.update(own)
            if confirmed:
                held.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([held[k] for k in n], pa.int64())], names=["unit", "n", "held"])


def _collected(bins: DataFrame) -> np.ndarray:
    counts = np.zeros(2 * REACH * BINS)
    for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most as many rows as bins
        counts[r["bin"]] = r["n"]
    return counts


def fit_on_tables(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> Scorer:
    """``documents``: doc_id, text; ``labels``: doc_id, offensive (1 or 0), several rows per document.  At most ``MAX_LABELLED`` labelled
    documents and ``MAX_UNLABELLED`` others are used for fitting the weights; counts, prior and threshold come from every document."""
    votes = labels.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg("offensive").alias("share"))
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    n_all = texts.count()
    looked = texts.select("doc_id").join(votes, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("share") > 0.5).alias("confirmed")).first()
    if not looked["confirmed"]:
        return Scorer(np.zeros(BUCKETS), -30.0)  # nothing confirmed
    n_labelled = looked["n"]
    n_others = n_all - n_labelled
    chosen = sample_by_hash(votes, "doc_id", MAX_LABELLED, n_labelled).join(texts, "doc_id")
    others = sample_by_hash(texts.join(votes, "doc_id", "left_anti"), "doc_id", MAX_UNLABELLED, max(1, n_others))
    labelled = [(r["text"], r["share"]) for r in chosen.orderBy("doc_id").collect()]
    unlabelled = [r["text"] for r in others.orderBy("doc_id").collect()]
    stands_for = n_labelled / max(1, len(labelled)), n_others / max(1, len(unlabelled))
    return train(labelled, unlabelled, corpus=_Tables(spark, texts, votes, n_all, looked["confirmed"]), stands_for=stands_for)


def score_documents(spark: SparkSession, documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``documents`` with ``score`` and ``flagged``: one row per row, null or empty texts score 0."""
    arrived = _broadcast(spark, scorer)
    fields = [f for f in documents.schema.fields if f.name not in ("score", "flagged")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double", "flagged boolean"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = arrived()
        for batch in batches:
            score = [mine.document(t) for t in batch.column("text").to_pylist()]
            made = [pa.array(score, pa.float64()), pa.array([x > flag_threshold() for x in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=[*names, "score", "flagged"])

    return documents.select(*names).mapInArrow(run, schema)
