"""Problem 8: documents that insult, threaten or degrade people or are sexually explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.llm.toxicity import fit_on_tables, score_documents
from spanwork.sources.tables import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scorer = fit_on_tables(spark, documents, table(spark, sf_dir, "doc_label"))
    return score_documents(spark, documents, scorer).drop("text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score", "flagged")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, spelt in one way: documents, flagged documents and their share."""
    return (
        _scored(spark, sf_dir)
        .groupBy(labels.squeezed(F.col("source")).alias("source"))
        .agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
    )


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
