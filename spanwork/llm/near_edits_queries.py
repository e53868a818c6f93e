"""Problem 4: task records of one split that ask for the same edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.near_edits import near_edit_groups
from spanwork.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_edit_groups(spark, table(spark, sf_dir, "task")).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of a group of at least two: the least record of its group, the group's size, its forms, and the links of the record's form."""
    found = near_edit_groups(spark, table(spark, sf_dir, "task"))
    keys = ["part", "g_hi", "g_lo"]
    groups = found.members.groupBy(*keys).agg(F.min("rec_id").alias("group_id"), F.count("*").alias("group_size"), F.countDistinct("hi", "lo").alias("n_forms"))
    ends = [found.links.select("part", F.col(f"{k}_hi").alias("hi"), F.col(f"{k}_lo").alias("lo")) for k in "ab"]
    degree = ends[0].unionByName(ends[1]).groupBy("part", "hi", "lo").agg(F.count("*").alias("n_links"))
    rows = found.members.join(groups.where("group_size > 1"), keys).join(degree, ["part", "hi", "lo"], "left")
    return rows.select("rec_id", "group_id", "group_size", "n_forms", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {}
