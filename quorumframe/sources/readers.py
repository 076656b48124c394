"""Readers and writers of the file shapes that pools, schemas and logs come in."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quorumframe.functions.textops import export_sql


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None, start: int = 0) -> DataFrame:
    """A file that holds one JSON array: its records with their place as dataset_index, from start, at most limit.

    The place is that of the array, not of a file split, so the file is read as one value.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", T.ArrayType(kind))).alias("dataset_index", "r")).select("dataset_index", "r.*")
    return rows.where((F.col("dataset_index") >= start) & (F.lit(limit is None) | (F.col("dataset_index") < start + (limit or 0))))


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of records, or an object with the array under 'items'."""
    text = spark.read.text(path, wholetext=True)
    arr = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema_struct(schema)}>>")).otherwise(F.from_json("value", f"items array<struct<{schema_struct(schema)}>>")["items"])
    return text.select(F.posexplode(arr).alias("pos", "r")).select("pos", "r.*")


def schema_struct(schema: str) -> str:
    """'a int, b string' as the inside of struct<…>."""
    return ", ".join(f"{p.split(None, 1)[0]}: {p.split(None, 1)[1]}" for p in schema.split(", "))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and broken lines and a byte order mark are skipped."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).where(F.trim("v") != "")
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    return text.select(F.from_json("v", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Schema metadata, one record a database; a repeated db_id raises."""
    kind = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
    raw = read_json_array(spark, path, kind).drop("dataset_index")
    twice = raw.groupBy("db_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"db_id {twice[0].db_id} comes twice")
    pair = lambda x: F.struct(x[0].cast("int").alias("table_idx"), x[1].alias("column_name"))
    link = lambda x: F.struct(x[0].alias("from_col"), x[1].alias("to_col"))
    return raw.withColumn("column_names_original", F.transform("column_names_original", pair)).withColumn("foreign_keys", F.transform("foreign_keys", link))


# Characters that windows-1252 has at the bytes where iso-8859-1 has controls.
LATIN = {chr(b): bytes([b]).decode("windows-1252") for b in range(0x80, 0xA0) if bytes([b]).decode("windows-1252", "ignore")}


def read_csv_encodings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in UTF-8 (with or without a byte order mark), or in windows-1252 where that leaves broken characters."""
    df = spark.read.csv(path, header=True, encoding="utf-8", multiLine=True)
    broken = any("\ufffd" in c for c in df.columns) or df.where(F.greatest(*[F.col(f"`{c}`").contains("\ufffd") for c in df.columns], F.lit(False))).limit(1).count() > 0
    if broken:  # Spark reads the one-byte set without those characters; they are put in afterwards
        df = spark.read.csv(path, header=True, encoding="iso-8859-1", multiLine=True)
        df = df.select(*[F.translate(F.col(f"`{c}`"), "".join(LATIN), "".join(LATIN.values())).alias("".join(LATIN.get(x, x) for x in c)) for c in df.columns])
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their number from 0, read in splits: lines are counted by split, and only the counts are put in order.

    A folder's files follow each other by name.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    before = W.orderBy("f", "b")
    counts = raw.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n")).select("f", "b", (F.sum("n").over(before) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("f", "b").orderBy("m"))
    return raw.withColumn("i", inside).join(F.broadcast(counts), ["f", "b"]).select((F.col("before") + F.col("i") - 1).alias("line"), F.col("value").alias("text"))


def read_line_pairs(spark: SparkSession, gold: str, pred: str) -> DataFrame:
    """Two line files joined by line number: gold query and db_id (tab-separated), and the prediction ('' where it lacks one)."""
    g = numbered_lines(spark, gold).select("line", F.split("text", "\t").alias("p")).select("line", F.col("p")[0].alias("gold_sql"), F.get("p", F.lit(1)).alias("db_id"))
    return g.join(numbered_lines(spark, pred).withColumnRenamed("text", "pred_sql"), "line", "left").withColumn("pred_sql", F.coalesce("pred_sql", F.lit("")))


def read_loss_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a training log that hold a {'loss': …} record, with its figures."""
    rec = F.regexp_extract("value", r"(\{'loss'.*\})", 1)
    fields = F.from_json(F.replace(rec, F.lit("'"), F.lit('"')), "loss double, grad_norm double, learning_rate double, epoch double")
    return spark.read.text(path).where(rec != "").select(fields.alias("r")).select("r.*")


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON-line shards of a glob with the file that each row comes from."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern).withColumn("shard", F.input_file_name())


def list_instances(root: str, db_id: str, most: int | None = None) -> list[str]:
    """Files of a database folder that are instances, the original first, the others sorted; [] for a missing folder."""
    folder = os.path.join(root, db_id)
    if not os.path.isdir(folder):
        return []
    names = sorted(n for n in os.listdir(folder) if ".sqlite" in n)
    names.sort(key=lambda n: n != f"{db_id}.sqlite")
    return [os.path.join(folder, n) for n in names[:most]]


def write_json_atomic(record: dict, path: str) -> None:
    """A JSON file put in place by a rename, so readers see the old or the new one."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(record, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def load_checkpoint(path: str, expect: dict | None = None) -> dict | None:
    """A checkpoint (completed_indices, items, run_config), None if there is none; raises on repeated or differing indices or another configuration."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        c = json.load(f)
    done, have = c.get("completed_indices"), [i.get("dataset_index") for i in c.get("items", [])]
    if not isinstance(done, list) or len(set(done)) != len(done) or len(set(have)) != len(have) or set(done) != set(have):
        raise ValueError("the checkpoint's indices do not match its items")
    if expect is not None and c.get("run_config") != expect:
        raise ValueError("the checkpoint is of another configuration")
    return c


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def export_lines(df: DataFrame, sql: str, order: str, path: str) -> None:
    """Predictions as text lines in order, SELECT 1 for nothing: range-sorted partitions, one file each in that order."""
    df.select(F.col(order).alias("o"), export_sql(F.col(sql)).alias("line")).orderBy("o").select("line").write.mode("overwrite").text(path)


def merge_items(a: DataFrame, b: DataFrame, index: str = "dataset_index") -> DataFrame:
    """Two item sets as one, in the order of their index."""
    return a.unionByName(b, allowMissingColumns=True).orderBy(index)


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 of whole files (path, sha256)."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def checkpoint_faults(completed: DataFrame, items: DataFrame, run: str = "run", index: str = "dataset_index") -> DataFrame:
    """For each run: indices that are completed twice, items that come twice, completed indices without an item, and items without a completed index."""
    a = completed.groupBy(run, index).agg(F.count(F.lit(1)).alias("na"))
    b = items.groupBy(run, index).agg(F.count(F.lit(1)).alias("nb"))
    j = a.join(b, [run, index], "full")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.groupBy(run).agg(n(F.col("na") > 1).alias("repeated_indices"), n(F.col("nb") > 1).alias("repeated_items"), n(F.col("nb").isNull()).alias("without_item"), n(F.col("na").isNull()).alias("without_index"))


def example_entries(records: DataFrame) -> DataFrame:
    """Examples (idx, record as JSON text) of two shapes as one table: idx, question, response, db_id, kind.

    Chat messages give the first user and the last assistant text; items give
    each candidate that ran, was judged right and keeps its whole response.
    Records of neither shape, and entries without question or response, give no
    rows.
    """
    kind = "messages array<struct<role: string, content: string>>, question string, db_id string, candidates array<struct<raw_response: string, execution_success: boolean, correct_vav: boolean>>"
    r = records.select("idx", F.from_json("record", kind).alias("r")).select("idx", "r.*")
    said = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    chat = r.where("messages is not null").select("idx", F.get(said("user"), F.lit(0)).alias("question"), F.try_element_at(said("assistant"), F.lit(-1)).alias("response"), F.lit(None).cast("string").alias("db_id"), F.lit("messages").alias("kind"))
    items = r.where("messages is null and candidates is not null").select("idx", "question", F.explode("candidates").alias("c"), "db_id").where("c.execution_success and c.correct_vav")
    items = items.select("idx", "question", F.col("c.raw_response").alias("response"), "db_id", F.lit("items").alias("kind"))
    return chat.unionByName(items).where("question is not null and question <> '' and trim(response) <> ''")
