"""Problem 7: evaluation items inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.llm.leaks import leaked_documents
from spanwork.sources.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_documents(spark, table(spark, sf_dir, "eval_item"), table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, its suite and split, and the number of documents that hold a passage of it."""
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    items = table(spark, sf_dir, "eval_item").select("item_id", "suite", "split")
    return items.join(found, "item_id", "left").fillna(0, ["n_documents"])


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL: dict[str, str] = {}
