"""Problem 6: documents in containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.packing import pack, token_counts
from spanwork.sources.tables import table


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "container_spec").where("capacity_tokens is not null").orderBy("spec_id").collect()]
    return pack(spark, token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", specs)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens, and the share of the space that is used."""
    specs = table(spark, sf_dir, "container_spec").select("spec_id", "capacity_tokens")
    used = p6_packing(spark, sf_dir).groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(specs, "spec_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


QUERIES = {"p6_packing": p6_packing, "p6_report": p6_report}
SQL: dict[str, str] = {}
