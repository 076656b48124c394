"""Session settings, table loading and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quorumframe", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for local work; on a cluster the submitted settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QF_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One test table as a parquet scan (column pruning and filters reach it)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a private one where it is unset on a single machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_qf_shared_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="quorumframe-")
        spark.sparkContext._qf_shared_dir = own
    return own


WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that written() has made so far; results that read them must be done."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, spark: SparkSession | None = None, *by: str) -> DataFrame:
    """Cut lineage: write df as a parquet table in the shared folder, in folders by the columns `by`, and read it back.

    Survives the loss of executors, and later reads prune columns and push filters.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, spread over them for a Python stage; others as they are.

    Only small inputs have so few splits, so the shuffle this takes is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: by path on this machine, as a zip on other ones. Once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_qf_shipped", False):
        return
    sc._qf_shipped = True
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if not sc.master.startswith("local"):
        path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quorumframe-"), "quorumframe"), "zip", root, os.path.basename(package))
        sc.addPyFile(path)
