"""Problem 2: task records of validation and test that also stand in the train split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.overlap import cross_split_overlap
from spanwork.session import stage_table
from spanwork.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_overlap(spark, table(spark, sf_dir, "task")).pairs()


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked classes of equal requests: the least record of either side, how many records each has, and their similarity (1 for one class)."""
    found = cross_split_overlap(spark, table(spark, sf_dir, "task"))
    side = lambda rows, k: rows.groupBy(F.col("hi").alias(f"{k}_hi"), F.col("lo").alias(f"{k}_lo")).agg(
        F.min("rec_id").alias(f"{k}_rec_id"), F.count("*").alias(f"{k}_records")
    )
    ev, tr = side(found.members.where("split <> 'train'"), "e"), side(found.members.where("split = 'train'"), "t")
    joined = found.links.join(ev, ["e_hi", "e_lo"]).join(tr, ["t_hi", "t_lo"])
    same = (F.col("e_hi") == F.col("t_hi")) & (F.col("e_lo") == F.col("t_lo"))
    return joined.select("e_rec_id", "t_rec_id", "e_records", "t_records", "similarity", same.alias("same_form"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and run of the evaluation records: records, those that leak, and pairs."""
    found = cross_split_overlap(spark, table(spark, sf_dir, "task"), ("run_id",))
    pairs = stage_table(spark, found.pairs(), "pairs").groupBy(F.col("eval_rec_id").alias("rec_id")).agg(F.count("*").alias("pairs"))
    return (
        found.members.where("split <> 'train'")
        .join(pairs, "rec_id", "left")
        .groupBy("split", "run_id")
        .agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p2_report": p2_report}
SQL: dict[str, str] = {}
