"""Incremental ingest of candidate files into the store, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quorumframe.sources.store import KEY, ingest


def stream_ingest(spark: SparkSession, source: str, schema: T.StructType | str, store: str, checkpoint: str, key: tuple[str, ...] = KEY) -> StreamingQuery:
    """Read new JSON-line files of a folder and append rows whose key is new; each file once, also after a restart."""
    lines = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: ingest(df.sparkSession, store, df, key)).start()


def windowed_counts(events: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Rows for each window of event time, late ones within the watermark counted in."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
