"""Differences between tables: keyed, as sets, as multisets, and of differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, status (created, deleted, modified) and the changed columns of rows that differ; null equals null."""
    a = before.select(*keys, F.struct(*columns).alias("a"))
    b = after.select(*keys, F.struct(*columns).alias("b"))
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    status = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.size("changed") > 0, "modified")
    both = a.join(b, keys, "full").withColumn("changed", changed).withColumn("status", status).where("status is not null")
    return both.select(*keys, "status", F.when(F.col("status") == "modified", F.col("changed")).otherwise(F.array().cast("array<string>")).alias("changed"))


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those of ``b`` with multiplicity, as (columns, surplus): counts are compared, rows never expanded."""
    columns = a.columns
    count = lambda df, sign: df.groupBy(*columns).agg(F.count("*").alias("c")).withColumn("c", F.col("c") * sign)
    return count(a, 1).unionByName(count(b.select(*columns), -1)).groupBy(*columns).agg(F.sum("c").alias("surplus")).where("surplus > 0")


def off_target(diff: DataFrame, allowed: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Changes outside the allowed ones; a created and a deleted thing of one kind cancel out (k cancel k)."""
    outside = diff.join(allowed.select(*keys).distinct(), keys, "left_anti")
    per = outside.groupBy(kind).agg(
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "deleted").alias("deleted"),
        F.count_if(F.col("status") == "modified").alias("modified"),
    )
    both = F.least("created", "deleted")
    return per.select(kind, (F.col("created") - both).alias("created"), (F.col("deleted") - both).alias("deleted"), "modified")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in their place, and what is new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def overlap(exploded: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b, common, size_a, size_b) of every two sets with common members: an equi-join on members, never all pairs of sets.

    ``exploded`` has one row per set and member, without repetition.
    """
    size = exploded.groupBy(key).agg(F.count("*").alias("size"))
    a, b = exploded.select(F.col(key).alias("a"), member), exploded.select(F.col(key).alias("b"), member)
    common = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return common.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")


def precision_recall(hit: Column, candidate: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Of sizes: both empty counts as perfect, one empty as 0."""
    none = (candidate == 0) & (reference == 0)
    one = lambda x: F.when(none, F.lit(1.0)).when((candidate == 0) | (reference == 0), F.lit(0.0)).otherwise(x)
    p, r = hit / candidate, hit / reference
    return one(p), one(r), one(F.when(hit == 0, F.lit(0.0)).otherwise(2 * hit / (candidate + reference)))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
