"""Run one SQL text over the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumframe.session import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "db_schemas", "questions", "candidates", "responses", "run_files", "eval_items", "context_windows")


def run_sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """spark.sql with the tables that the text names bound to the folder's parquet scans."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            load(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(text)


def plan(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable for a SQL text that both engines understand."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return run_sql(spark, d, text)

    query.__doc__ = " ".join(text.split())[:100]
    return query
