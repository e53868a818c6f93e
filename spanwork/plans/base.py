"""Views that several plans share, and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.sources.tables import latest, table

AXES = ("geometry", "semantics", "topology")
#: An edit counts as completed from this value of every axis on.
COMPLETED_AT = 0.9


def least_axis() -> Column:
    """The worst of the three axes; a missing one counts as 0."""
    return F.least(*[F.coalesce(F.col(f"score.{a}"), F.lit(0.0)) for a in AXES])


def completed(threshold: float = COMPLETED_AT) -> Column:
    return least_axis() >= threshold


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each adapter and task."""
    raw = table(spark, sf_dir, "task_result")
    names = [c for c in raw.columns if c not in ("adapter", "task_id")]
    best = F.max_by(F.struct(*names), F.struct("run_at", "input_tokens")).alias("b")
    kept = raw.where("adapter is not null and task_id is not null").groupBy("adapter", "task_id").agg(best)
    return kept.select("adapter", "task_id", *[F.col("b")[c].alias(c) for c in names])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the latest run of each adapter and task completed.

    The verdict is taken before the latest run is looked for: no other column of the runs is read, sorted or sent.
    """
    raw = table(spark, sf_dir, "task_result").where("adapter is not null and task_id is not null")
    return raw.groupBy("adapter", "task_id").agg(F.max_by(completed(), F.struct("run_at", "input_tokens")).alias("done"))


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest delivery of each task record."""
    return latest(table(spark, sf_dir, "task"), "rec_id", "loaded_at", columns=list(columns))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task id with clean labels: the record that was loaded last."""
    raw = table(spark, sf_dir, "task").where("task_id is not null")
    fields = F.struct(
        labels.operation(F.col("operation")).alias("operation"),
        labels.category(F.col("category")).alias("category"),
        labels.ifc_version(F.col("ifc_version")).alias("version"),
        labels.code(F.col("building_id")).alias("building"),
        "tier",
        "origin",
        "families",
    )
    best = F.max_by(fields, F.struct("loaded_at", "rec_id")).alias("b")
    return raw.groupBy("task_id").agg(best).select("task_id", "b.*")


RESULTS = """r AS (SELECT * FROM task_result WHERE adapter IS NOT NULL AND task_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY adapter, task_id ORDER BY run_at DESC, input_tokens DESC NULLS LAST) = 1)"""
DONE = "(least(coalesce(score.geometry, 0), coalesce(score.semantics, 0), coalesce(score.topology, 0)) >= 0.9)"
SQUEEZE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
OPERATION = f"CASE WHEN {SQUEEZE} LIKE 'cre%' THEN 'create' WHEN {SQUEEZE} LIKE 'upd%' THEN 'update' WHEN {SQUEEZE} LIKE 'del%' THEN 'delete' END".replace("{0}", "operation")
CATEGORY = f"CASE WHEN {SQUEEZE} LIKE 'dir%' THEN 'direct' WHEN {SQUEEZE} LIKE 'spa%' THEN 'spatial' WHEN {SQUEEZE} LIKE 'top%' THEN 'topological' END".replace("{0}", "category")
_V = f"regexp_replace(regexp_replace({SQUEEZE}, '^ifc', ''), '(add[0-9]*|tc[0-9]*|final)+$', '')".replace("{0}", "ifc_version")
VERSION = f"CASE WHEN {_V} IN ('2x3', '23') THEN 'IFC2X3' WHEN {_V} IN ('4', '40', '4x0') THEN 'IFC4' WHEN {_V} IN ('4x3', '43') THEN 'IFC4X3' END"
_B = f"upper({SQUEEZE})".replace("{0}", "building_id")
BUILDING = f"CASE WHEN regexp_matches({_B}, '[1-9]') AND length({_B}) > 1 THEN {_B} END"
SPLIT = f"CASE WHEN {SQUEEZE} LIKE 'tr%' THEN 'train' WHEN {SQUEEZE} LIKE 'val%' THEN 'validation' WHEN {SQUEEZE} LIKE 'te%' THEN 'test' END".replace("{0}", "split")
TASKS = f"""k AS (SELECT task_id, {OPERATION} AS operation, {CATEGORY} AS category, {VERSION} AS version, {BUILDING} AS building, tier, origin, families FROM task
  WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC, rec_id DESC) = 1)"""
RECORDS = "t AS (SELECT * FROM task WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1)"
MODEL = r"nullif(regexp_extract(regexp_replace(lower(trim(input_ifc)), '[\\/]+(\.[\\/]+)*', '/', 'g'), '([^/:]+/[^/:]+\.[a-z0-9]+)$', 1), '')"
