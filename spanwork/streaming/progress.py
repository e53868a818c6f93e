"""Streams of results and calls: repeated deliveries, running funnels, loops while they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; times without one are read in the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def first_deliveries(df: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the delay."""
    return timed(df, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def running_funnel(df: DataFrame, stage: str, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per stage and window of event time; rows later than the delay are left out."""
    return timed(df, time).withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), stage).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), stage, "n")


def sessions(df: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    rows = timed(df, time).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def loops(df: DataFrame, key: str, call: str, limit: int = 3) -> DataFrame:
    """(key, call, run) as soon as a key repeats one call ``limit`` times in a row; state is one call and one count per key."""

    def follow(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        found = []
        for frame in frames:
            for c in frame[call]:
                run = run + 1 if c == last else 1
                last = c
                if run == limit:
                    found.append((name[0], c, run))
        state.update((last, run))
        yield pd.DataFrame(found, columns=[key, call, "run"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, {call} string, run int", "last string, run int", "append", GroupStateTimeout.NoTimeout)
