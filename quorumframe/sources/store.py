"""An append-only candidate store on parquet, partitioned by model and adapter."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = ("di", "model", "lora", "temperature", "seed", "prompt_hash")


def query_store(store: DataFrame, **where: object) -> DataFrame:
    """Rows equal in all given columns, a None meaning null, in the order of id."""
    out = store
    for c, v in where.items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    return out.orderBy("id")


def new_rows(store: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Incoming rows whose key the store lacks, one a key (the smallest id); nulls in keys are equal."""
    flat = lambda df: df.withColumn("_k", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]))
    cols = incoming.columns
    once = incoming.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct("id", F.to_json(F.struct(*cols)))).alias("_r")).select("_r.*")
    have = store.select(*key).distinct()
    a, b = flat(once).alias("a"), flat(have).alias("b")
    on = F.col("a._k") == F.col("b._k")
    for c in key:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left_anti").drop("_k")


def ingest(spark: SparkSession, path: str, incoming: DataFrame, key: tuple[str, ...] = KEY) -> dict[str, int]:
    """Append what is new to the store at path and return added, skipped and total. A missing store is made."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    store = spark.read.parquet(path) if exists else spark.createDataFrame([], incoming.schema)
    came, put = Observation("came"), Observation("put")
    n = F.count(F.lit(1)).alias("n")
    # Both are counted while the one job runs; the total comes from the files' footers.
    new_rows(store, incoming.observe(came, n), key).observe(put, n).write.mode("append").parquet(path)
    added, given = put.get["n"], came.get["n"]
    return {"added": added, "skipped": given - added, "total": spark.read.parquet(path).count()}


def store_stats(store: DataFrame) -> DataFrame:
    """Rows, questions and models in the store, and its ten largest model and adapter pairs."""
    return store.groupBy("model", "lora").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("di").alias("questions")).orderBy(F.desc("n"), "model", F.col("lora").asc_nulls_first()).limit(10)


def fingerprint(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while b := f.read(block):
            h.update(b)
    return h.hexdigest()
