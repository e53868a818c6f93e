"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, *newest: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest ``newest`` columns (later columns break ties).

    A hash aggregate with map-side combine instead of a window, so a key that is delivered a million times
    never gathers in one task.  Rows with a null key are each their own record and are dropped: they name nothing.
    """
    names = columns or [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*names), F.struct(*newest))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_best"))
    return kept.select(key, *[F.col("_best")[c].alias(c) for c in names])


def text_or(first: Column, second: Column) -> Column:
    """``first``, or ``second`` where it is null."""
    return F.coalesce(first, second)
