"""Records of evaluation splits that stand, exactly or nearly, in the training split.

An exact prefix-filter join: every canonical form is a set of word shingles in one global order, rare ones first; two
sets of similarity ``t`` share one of their first ``n - ceil(t n) + 1`` shingles, so evaluation prefixes are the index,
training prefixes probe it, length and position filters discard what cannot reach ``t``, and the overlap of the rest
is counted on the texts, as are figures and words.  Copies are joined as one form and spread to their records at the end.

Scale: the join key holds source model and shingle, rare shingles first, so a source model with a third of all rows falls
into as many keys as it has different elements and figures.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.requests import THRESHOLD, requests_table, same_edit, similarity
from spanwork.session import stage_table

CLASS = ["hi", "lo"]
KEYS = ["e_hi", "e_lo", "t_hi", "t_lo"]


@dataclass
class Overlap:
    members: DataFrame  # rec_id, split, extra columns, block, hi, lo
    links: DataFrame  # e_hi, e_lo, t_hi, t_lo, similarity: a form of an evaluation split and one of the training split

    def pairs(self) -> DataFrame:
        ev = self.members.where("split <> 'train'").select(F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"), F.col("rec_id").alias("eval_rec_id"))
        tr = self.members.where("split = 'train'").select(F.col("hi").alias("t_hi"), F.col("lo").alias("t_lo"), F.col("rec_id").alias("train_rec_id"))
        return self.links.join(ev, ["e_hi", "e_lo"]).join(tr, ["t_hi", "t_lo"]).select("eval_rec_id", "train_rec_id")


def cross_split_overlap(spark: SparkSession, task: DataFrame, extra: tuple[str, ...] = (), threshold: float = THRESHOLD) -> Overlap:
    """All pairs of an evaluation and a training record that ask for the same edit of the same source model.

    Nulls: a record without id, split, path or text takes no part.  Empty tables give no pairs.  Repeated
    deliveries count once, the latest.  Texts of any length are used whole.  Other columns are ignored.
    """
    found = requests_table(spark, task, extra, prefixes=True)
    words, wordings = found.words, found.wordings
    members = stage_table(spark, found.members(extra), "members")
    is_train = F.col("split") == "train"
    roles = members.groupBy("block", *CLASS).agg(F.max(is_train).alias("t"), F.max(~is_train).alias("e"))
    roles = stage_table(spark, roles, "roles")
    shared = roles.groupBy("block").agg(F.max("t").alias("t"), F.max("e").alias("e")).where("t and e").select("block")
    forms = found.rows.where(F.col("block").isNotNull()).groupBy("block", *CLASS)
    forms = forms.agg(*[F.first(c).alias(c) for c in ("fig", "n", "prefix", "canonical")])
    # how large these tables are in memory is not in the statistics, so the joins are not left to an estimate that might broadcast
    forms = stage_table(spark, forms.join(roles.join(shared.hint("merge"), "block", "left_semi").hint("merge"), ["block", *CLASS]), "forms")

    def side(role: str, letter: str) -> DataFrame:
        rows = forms.where(role).select("block", *CLASS, "fig", "n", F.posexplode("prefix").alias("at", "shingle"))
        return rows.select("block", "shingle", *[F.col(c).alias(f"{letter}_{c}") for c in (*CLASS, "fig", "n", "at")])

    most = F.least(F.col("e_n") - F.col("e_at"), F.col("t_n") - F.col("t_at"))  # shingles left from here on
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("e_n") + F.col("t_n")) - 1e-9)
    fits = (F.least("e_n", "t_n") >= F.lit(threshold) * F.greatest("e_n", "t_n") - 1e-9) & (most + F.least("e_at", "t_at") >= need)
    fits &= (F.col("e_fig") == F.col("t_fig")) & ((F.col("e_hi") != F.col("t_hi")) | (F.col("e_lo") != F.col("t_lo")))
    candidates = side("e", "e").hint("merge").join(side("t", "t"), ["block", "shingle"]).where(fits).select(*KEYS).distinct()
    text = forms.select(*CLASS, "canonical")
    candidates = candidates.join(text.toDF("e_hi", "e_lo", "e_text").hint("merge"), ["e_hi", "e_lo"])
    candidates = candidates.join(text.toDF("t_hi", "t_lo", "t_text").hint("merge"), ["t_hi", "t_lo"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("e_text").to_pylist(), batch.column("t_text").to_pylist()))
            alike = [similarity(a, b) for a, b in both]
            good = [s >= threshold - 1e-9 and same_edit(a, b, words, wordings) for s, (a, b) in zip(alike, both)]
            kept = batch.select(KEYS).append_column("similarity", pa.array(alike, pa.float64()))
            yield kept.filter(pa.array(good, pa.bool_()))

    near = candidates.select(*KEYS, "e_text", "t_text").mapInArrow(verify, ", ".join(f"{k} long" for k in KEYS) + ", similarity double")
    one = [F.col(c).alias(f"{letter}_{c}") for letter in "et" for c in CLASS]  # a form that both sides hold
    return Overlap(members, roles.where("e and t").select(*one, F.lit(1.0).alias("similarity")).unionByName(near))
