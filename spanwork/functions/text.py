"""Text as column expressions: normal forms, tokens, n-grams, facts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What typographic quotes, dashes and spaces become.
QUOTES = ("\u2018\u2019\u201a\u201b`\u00b4\u201c\u201d\u201e\u201f\u00ab\u00bb\u2013\u2014\u00a0\u2009\u202f", "''''''\"\"\"\"\"\"--   ")
#: A 22-character identifier, which begins with 0 to 3, with nothing of its alphabet beside it.
GUID = r"(?<![0-9A-Za-z_$])[0-3][0-9A-Za-z_$]{21}(?![0-9A-Za-z_$])"
#: Words that stand for a place in an order.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


@F.pandas_udf(StringType())
def strip_accents(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case without accents; Spark has no Unicode normal forms, so this is an Arrow kernel."""
    for s in parts:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)), na_action="ignore")


def tidy(c: Column) -> Column:
    """Plain quotes and single spaces."""
    return F.trim(F.regexp_replace(F.translate(c, *QUOTES), r"\s+", " "))


def words(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens, joined; no run for fewer tokens.

    The tokens are bound to a lambda variable first: inside ``transform`` an expression would be evaluated anew for every run.
    """

    def runs(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(t) - (n - 1))
        made = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " ")))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), runs)[0]


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct runs of ``n`` tokens, made from hashes of the tokens: no run is written out as text."""

    def runs(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(t) - (n - 1))
        made = F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(t, i + (k - 1)) for k in range(n)])))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), runs)[0]


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def guids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(GUID), F.lit(0)))


def numbers(c: Column) -> Column:
    """Figures as they stand, with words such as "second" as their figure."""
    text = c
    for i, w in enumerate(ORDINALS, 1):
        text = F.regexp_replace(text, rf"\b{w}\b", str(i))
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def stem_key(path: Column) -> Column:
    """File name without folders, type, leading number and trailing date."""
    name = F.regexp_replace(F.lower(F.trim(path)), r"^.*[\\/]", "")
    for pattern in (r"\.[a-z0-9]+$", r"^[0-9]+[_-]+", r"[_-]*[0-9]{4}[_-]?[0-9]{2}[_-]?[0-9]{2}$"):
        name = F.regexp_replace(name, pattern, "")
    return name


def middle_cut(c: Column, most: int) -> Column:
    """Head and tail of a text longer than ``most``, with an ellipsis between."""
    head = (most - 3) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(most - 3 - head))))


def asks(reply: Column, keywords: Column) -> Column:
    """The reply holds a question mark and one of the keywords as a whole word."""
    return F.coalesce(F.contains(reply, F.lit("?")) & F.arrays_overlap(F.split(F.lower(reply), r"[^a-z]+"), F.transform(keywords, F.lower)), F.lit(False))
