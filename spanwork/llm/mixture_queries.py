"""Problem 1: samples by operation, category and version out of the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.llm.mixture import Mixture, match_proportions
from spanwork.sources.tables import latest, table

DIMS = ["operation", "category", "ifc_version"]


def mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    task = latest(table(spark, sf_dir, "task"), "rec_id", "loaded_at", columns=["split", "operation", "category"])
    props = latest(table(spark, sf_dir, "request_props"), "task_id", "loaded_at", columns=["operation", "ifc_version"])
    tasks = task.where(labels.split(F.col("split")) == "train").select(
        F.lit("task").alias("pool_table"),
        F.col("rec_id").cast("string").alias("rec_key"),
        labels.operation(F.col("operation")).alias("operation"),
        labels.category(F.col("category")).alias("category"),
        F.lit(None).cast("string").alias("ifc_version"),
    )
    requests = props.select(
        F.lit("request_props").alias("pool_table"),
        F.col("task_id").alias("rec_key"),
        labels.operation(F.col("operation")).alias("operation"),
        F.lit(None).cast("string").alias("category"),
        labels.ifc_version(F.col("ifc_version")).alias("ifc_version"),
    )
    return match_proportions(spark, tasks.unionByName(requests), table(spark, sf_dir, "mix_target"), DIMS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).report.where(F.col("gap") > 0).select("mix_id", "stratum")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).report.select("mix_id", "stratum", "wanted", "available", "gap")


def p1_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stratum: the share wanted, what raking made of it, and what the first draw and the repaired one hold."""
    return mixture(spark, sf_dir).report.select("mix_id", "stratum", "share", "raked", "first_draw", "drawn", "residual")


def p1_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per single column of each mix: rows wanted, drawn, and the residual gap."""
    return mixture(spark, sf_dir).margins()


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, sf_dir).sample.select("mix_id", "stratum", "rec_key", "first_draw")


_LABELS = """
WITH t AS (
  SELECT rec_id, arg_max(struct_pack(s := split, o := operation, c := category), loaded_at) AS r FROM task GROUP BY rec_id
), q AS (
  SELECT task_id, arg_max(struct_pack(o := operation, v := ifc_version), loaded_at) AS r FROM request_props GROUP BY task_id
), raw AS (
  SELECT 'task' AS pool_table, regexp_replace(lower(r.o), '[^a-z0-9]', '', 'g') AS o, regexp_replace(lower(r.c), '[^a-z0-9]', '', 'g') AS c, NULL AS v
  FROM t WHERE lower(trim(r.s)) LIKE 'tr%'
  UNION ALL
  SELECT 'request_props', regexp_replace(lower(r.o), '[^a-z0-9]', '', 'g'), NULL,
    regexp_replace(regexp_replace(regexp_replace(lower(r.v), '[^a-z0-9]', '', 'g'), '^ifc', ''), '(add[0-9]*|tc[0-9]*|final)+$', '') FROM q
), pool AS (
  SELECT pool_table,
    CASE WHEN o LIKE 'cre%' THEN 'create' WHEN o LIKE 'upd%' THEN 'update' WHEN o LIKE 'del%' THEN 'delete' END AS operation,
    CASE WHEN c LIKE 'dir%' THEN 'direct' WHEN c LIKE 'spa%' THEN 'spatial' WHEN c LIKE 'top%' THEN 'topological' END AS category,
    CASE WHEN v IN ('2x3', '23') THEN 'IFC2X3' WHEN v IN ('4', '40', '4x0') THEN 'IFC4' WHEN v IN ('4x3', '43') THEN 'IFC4X3' END AS ifc_version
  FROM raw
), held AS (
  SELECT m.mix_id, m.stratum, greatest(m.min_rows::DOUBLE, m.sample_size * m.target_permille / 1000.0) AS wanted,
    count(p.pool_table) AS available
  FROM mix_target m LEFT JOIN pool p ON p.pool_table = m.pool_table AND m.stratum =
    CASE m.dims WHEN 'operation' THEN p.operation WHEN 'category' THEN p.category WHEN 'ifc_version' THEN p.ifc_version
      WHEN 'operation|category' THEN p.operation || '|' || p.category WHEN 'ifc_version|operation' THEN p.ifc_version || '|' || p.operation END
  GROUP BY ALL
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_drawn": p1_drawn, "p1_margins": p1_margins, "p1_sample": p1_sample}
SQL = {
    "p1_found": _LABELS + "SELECT mix_id, stratum FROM held WHERE available < wanted",
    "p1_report": _LABELS + "SELECT mix_id, stratum, wanted, available, greatest(0.0, wanted - available) AS gap FROM held",
}
