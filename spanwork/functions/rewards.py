"""Rewards of edits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(final: Column, untouched: Column) -> Column:
    """Score above that of the untouched model, as share of what was to gain, between -0.2 and 1."""
    room = F.nullif(1 - F.coalesce(untouched, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-0.2), F.least(F.lit(1.0), F.coalesce((F.coalesce(final, F.lit(0.0)) - F.coalesce(untouched, F.lit(0.0))) / room, F.lit(0.0))))


def less_errors(reward: Column, raised: Column, each: float = 0.02, most: float = 0.10) -> Column:
    """A deduction per failed call, capped."""
    return reward - F.least(F.lit(most), F.lit(each) * raised)


def commit_gate(reward: Column, committed: Column) -> Column:
    """Without a commit there is nothing to gain."""
    return F.when(F.coalesce(committed, F.lit(False)), reward).otherwise(F.least(F.lit(0.0), reward))
