"""Labels, codes and paths that many hands wrote: each function maps the spellings of a value to one form.

All are built-in column expressions, so they stay in whole-stage code and can be pushed below joins.
A spelling that fits no known label gives null, as does null itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical labels.
OPERATIONS = ("create", "update", "delete")
CATEGORIES = ("direct", "spatial", "topological")
SPLITS = ("train", "validation", "test")
VERSIONS = ("IFC2X3", "IFC4", "IFC4X3")

# Words that writers use where a value is not known.
UNKNOWN_WORDS = (
    "", "-", "--", "?", "??", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unk", "unbekannt",
    "inconnu", "desconocido", "not known", "tbd", "tba", "tbc", "todo", "anon", "anonymous", "external", "extern",
    "guest", "user", "various", "misc", "other", "missing", "not set", "unset", "default", "test", "x", "xx", "xxx", "0",
)


def squeezed(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _by_prefix(c: Column, names: tuple[str, ...]) -> Column:
    key = squeezed(c)
    out = None
    for name in names:
        hit = key.startswith(name[:3])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def operation(c: Column) -> Column:
    """create, update or delete; abbreviations and noun forms begin with the same three letters."""
    return _by_prefix(c, OPERATIONS)


def category(c: Column) -> Column:
    return _by_prefix(c, CATEGORIES)


def split(c: Column) -> Column:
    """train, validation or test; ``dev`` and ``eval`` count as validation."""
    key = squeezed(c)
    return (
        F.when(key.startswith("tr"), F.lit("train"))
        .when(key.startswith("val") | key.isin("dev", "eval", "evaluation", "development"), F.lit("validation"))
        .when(key.startswith("te"), F.lit("test"))
    )


def ifc_version(c: Column) -> Column:
    """IFC2X3, IFC4 or IFC4X3; suffixes for addenda (ADD) and corrigenda (TC) belong to their version."""
    key = F.regexp_replace(F.regexp_replace(squeezed(c), "^ifc", ""), "(add[0-9]*|tc[0-9]*|final)+$", "")
    return (
        F.when(key.isin("2x3", "23"), F.lit("IFC2X3"))
        .when(key.isin("4", "40", "4x0"), F.lit("IFC4"))
        .when(key.isin("4x3", "43"), F.lit("IFC4X3"))
    )


def known(c: Column) -> Column:
    """The trimmed value, or null where it is a word for "not known"."""
    value = F.trim(c)
    return F.when(~F.lower(value).isin(*UNKNOWN_WORDS), value)


def code(c: Column) -> Column:
    """A short code (writer, building): case, padding and separators do not matter; a code holds a digit other than 0,
    so words that stand for "not known", and codes that are all zeros, give null."""
    key = F.upper(squeezed(F.trim(c)))
    return F.when(key.rlike("[1-9]") & (F.length(key) > 1), key)


def model_key(path: Column) -> Column:
    """Folder name and file name at the end of a path, letter case aside; null when either is missing."""
    tidy = F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+(\.[\\/]+)*", "/")
    return F.nullif(F.regexp_extract(tidy, r"([^/:]+/[^/:]+\.[a-z0-9]+)$", 1), F.lit(""))
