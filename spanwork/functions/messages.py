"""Conversations held in arrays: messages are structs of role, content and tool_calls (name, arguments)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_code(arguments: Column) -> Column:
    """The code of a tool call whose arguments are a JSON object or the code itself."""
    return F.coalesce(F.get_json_object(arguments, "$.code"), F.when(~F.startswith(F.ltrim(arguments), F.lit("{")), arguments))


def prompt_part(messages: Column) -> Column:
    """The messages before the first assistant's; all of them when there is none."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant").cast("int")
    return F.when(at > 0, F.slice(messages, F.lit(1), at - 1)).otherwise(messages)


def loss_mask(messages: Column) -> Column:
    """True for what the assistant wrote."""
    return F.transform(messages, lambda m: m["role"] == "assistant")


def longest_repeat(codes: Column) -> Column:
    """Longest run of the same code in a row: a fold over the array, not a window."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        run = F.when(c.eqNullSafe(s["last"]) & (s["run"] > 0), s["run"] + 1).otherwise(F.lit(1))
        return F.struct(c.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(codes, start, step, lambda s: s["best"])


def tidy_code(code: Column) -> Column:
    """Code without blank lines; indentation stays, other runs of blanks become one."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.rtrim(x)), lambda x: F.length(x) > 0)
    inner = F.transform(lines, lambda x: F.concat(F.regexp_extract(x, r"^(\s*)", 1), F.regexp_replace(F.ltrim(x), r"\s+", " ")))
    return F.array_join(inner, "\n")
