"""The event pool: a table of made-up samples with one-cell results, on which both engines can follow every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.operators import pool as P
from quorumframe.session import load

INSTANCES = 3


def event_pool(events: DataFrame) -> DataFrame:
    """Each event is one sampled query of the user's question, with its one-cell result."""
    cell = F.floor(F.col("value") / 50).cast("int")
    return events.select(
        F.col("user_id").alias("qid"),
        F.col("event_id").alias("sample_idx"),
        F.when(F.col("event_id") % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.when(F.col("event_type") != "error", cell).alias("res_cell"),
        F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "signup", "none").otherwise("ok").alias("status"),
        F.concat(F.lit("SELECT  "), F.upper("event_type"), F.lit(" "), cell.cast("string")).alias("sql_text"),
    )


def dedupe(pool: DataFrame) -> DataFrame:
    """Entries with their cell and status."""
    return P.dedupe(pool, F.max("res_cell").alias("res_cell"), F.max("status").alias("status"))


def signature(status: Column, cell: Column, qid: Column, instance: int) -> Column:
    """Signature of a one-cell result in an instance: ERROR, E (no rows) or the typed cell."""
    return F.when(status == "err", "ERROR").when(status == "none", "E").otherwise(F.concat(F.lit("I"), ((cell + qid * instance) % 7).cast("string")))


def with_vectors(entries: DataFrame, instances: int = INSTANCES) -> DataFrame:
    """Entries with the signature vector over the instances."""
    sigs = [signature(F.col("status"), F.col("res_cell"), F.col("qid"), k) for k in range(instances)]
    return entries.withColumn("vector", F.array(*sigs)).withColumn("score", F.round((F.col("min_idx") * 7919 % 1000) / 1000.0, 3))


def entries_of(spark: SparkSession, d: str, model: str | None = None, instances: int = INSTANCES) -> DataFrame:
    pool = event_pool(load(spark, d, "events"))
    return with_vectors(dedupe(pool.where(F.col("model") == model) if model else pool), instances)


def judged(winners: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether each winner's result equals the pool's gold result in every instance."""
    gold = [F.concat(F.lit("I"), ((F.col("qid") % 5 + F.col("qid") * k) % 7).cast("string")) for k in range(INSTANCES)]
    return P.judged(winners, entries.select("qid", F.col("key").alias("rep"), F.coalesce(F.col("vector") == F.array(*gold), F.lit(False)).alias("correct")))
