"""Spark-first data work around training and evaluating models on structured edit tasks."""

__version__ = "0.1.0"
