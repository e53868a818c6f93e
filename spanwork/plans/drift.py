"""Problem 5: raw records whose fields change from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwork.operators.schema_drift import consistent_table, schema_drift
from spanwork.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift(spark, table(spark, sf_dir, "raw_record")).changes.select("file_id", "field_path", "change_kind")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_record")
    return consistent_table(spark, lines, schema_drift(spark, lines))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table}
SQL: dict[str, str] = {}
