"""A stored cache of executed texts: distinct (db_id, sql) that it lacks are run and appended, the rest is read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from quorumframe.session import shared_dir
from quorumframe.sqltools.instances import VECTORS, execute_texts


def cache_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/runs-{hashlib.sha256(name.encode()).hexdigest()[:12]}"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What the cache holds; an empty table where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(VECTORS).parquet(path) if there else spark.createDataFrame([], VECTORS)


def cached_vectors(tasks: DataFrame, images: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Outcomes of the tasks (db_id, sql): those the cache of this name lacks are executed and appended to it first.

    The name must tell one set of images from another: give their fingerprint.

    Two runs that miss the same text at once both append it, with equal
    signatures; readers take one of them.
    """
    path = cache_path(spark, name)
    want = tasks.where("db_id is not null and sql is not null").select("db_id", "sql").distinct()
    missing = want.join(stored(spark, path).select("db_id", "sql"), ["db_id", "sql"], "left_anti")
    execute_texts(missing, images).write.mode("append").parquet(path)
    return stored(spark, path).join(want, ["db_id", "sql"], "left_semi").dropDuplicates(["db_id", "sql"])
