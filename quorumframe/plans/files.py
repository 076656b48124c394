"""Queries on sources and sinks: tables written in the shapes that pools, schemas and logs come in, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import WRITTEN, load, shared_dir
from quorumframe.sources import readers as R
from quorumframe.sources import store as ST


def _path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def _as_text(df: DataFrame, path: str) -> str:
    """One column of lines as one text file (small fixtures only)."""
    df.repartition(1).write.text(path)
    return path


def _array_file(spark, d) -> str:
    """The evaluation items (a table of fixed size) as one JSON array in a file."""
    items = load(spark, d, "eval_items").select("item_id", "split_name", "item_text")
    return _as_text(items.agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "split_name", "item_text")))).alias("v")), _path(spark, "array"))


def read_array(spark, d):
    """Records 20 to 119 of a file that holds one JSON array, with their place."""
    return R.read_json_array(spark, _array_file(spark, d), "item_id bigint, split_name string, item_text string", limit=100, start=20)


def read_wrapped(spark, d):
    """An array of records and an object that holds one under 'items', by one reader."""
    kind = "item_id bigint, split_name string, item_text string"
    items = load(spark, d, "eval_items").select("item_id", "split_name", "item_text")
    wrapped = items.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("item_id", "split_name", "item_text"))).alias("items"))).alias("v"))
    a = R.read_items(spark, _array_file(spark, d), kind).withColumn("shape", F.lit("array"))
    b = R.read_items(spark, _as_text(wrapped, _path(spark, "wrapped")), kind).withColumn("shape", F.lit("object"))
    return a.unionByName(b).select("shape", "pos", "item_id")


def read_metadata(spark, d):
    """Schema metadata in its file shape (pairs as arrays) read into the table's shape."""
    pair = F.transform("column_names_original", lambda c: F.array(c["table_idx"].cast("string"), c["column_name"]))
    link = F.transform("foreign_keys", lambda c: F.array(c["from_col"], c["to_col"]))
    s = load(spark, d, "db_schemas").select("db_id", "table_names_original", pair.alias("column_names_original"), "column_types", "primary_keys", link.alias("foreign_keys"))
    path = _as_text(s.agg(F.to_json(F.collect_list(F.struct(*s.columns))).alias("v")), _path(spark, "tables"))
    m = R.read_schemas(spark, path)
    return m.select("db_id", F.size("table_names_original").alias("n_tables"), F.size("column_names_original").alias("n_columns"), F.element_at("column_names_original", 2)["column_name"].alias("first_column"), F.size("foreign_keys").alias("n_links"))


def read_lines(spark, d):
    """JSON lines with blank and broken lines and a byte order mark between the good ones."""
    c = load(spark, d, "candidates").select("id", "di", "model").dropDuplicates(["id"])
    good = F.concat(F.when(F.col("id") % 5 == 0, F.lit("﻿")).otherwise(""), F.to_json(F.struct("id", "di", "model")))
    lines = c.select(F.explode(F.array(good, F.lit(""), F.concat(F.lit('{"id": '), F.col("id").cast("string")))).alias("v"))
    path = _path(spark, "lines")
    lines.write.text(path)
    return R.read_json_lines(spark, path, "id bigint, di int, model string")


def read_csv_latin(spark, d):
    """A CSV file in a one-byte encoding, found by the first encoding that leaves no broken characters."""
    q = load(spark, d, "db_schemas").select("db_id", F.concat(F.lit("größe-"), F.element_at("table_names_original", 1)).alias("label"))
    path = _path(spark, "csv")
    q.repartition(1).write.option("header", True).option("encoding", "iso-8859-1").csv(path)
    return R.read_csv_encodings(spark, path)


def read_pairs(spark, d):
    """Gold and predicted queries of two line files, joined by line number; missing predictions are empty."""
    q = load(spark, d, "questions").where("gold_sql is not null and di >= 0").groupBy("di").agg(F.min("gold_sql").alias("g"), F.min("db_id").alias("db_id"))
    flat = F.regexp_replace("g", r"\s+", " ")
    gold, pred = _path(spark, "gold"), _path(spark, "pred")
    q.select("di", F.concat_ws("\t", flat, "db_id").alias("v")).repartition(1).sortWithinPartitions("di").select("v").write.text(gold)
    q.where("di % 10 <> 9").select("di", F.upper(flat).alias("v")).repartition(1).sortWithinPartitions("di").select("v").write.text(pred)
    return R.read_line_pairs(spark, gold, pred).groupBy("db_id", (F.col("pred_sql") == "").alias("missing")).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def read_log(spark, d):
    """Loss records of a training log between other lines."""
    e = load(spark, d, "events").select("event_id", F.round("value", 3).alias("v"))
    record = F.concat(F.lit("step {'loss': "), F.col("v").cast("string"), F.lit(", 'grad_norm': 1.5, 'learning_rate': 1e-05, 'epoch': "), (F.col("event_id") % 7).cast("string"), F.lit("}"))
    path = _path(spark, "log")
    e.select(F.explode(F.array(F.lit("progress 3%"), record)).alias("v")).write.text(path)
    r = R.read_loss_log(spark, path)
    return r.groupBy(F.col("epoch").cast("int").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("loss"), 3).alias("low"), F.round(F.max("loss"), 3).alias("high"))


def read_all_shards(spark, d):
    """Shards of JSON lines read by a pattern, each row with its shard."""
    c = load(spark, d, "candidates").select("id", "di", (F.col("id") % 4).cast("int").alias("part")).dropDuplicates(["id"])
    path = _path(spark, "shards")
    c.write.partitionBy("part").json(path)
    r = R.read_shards(spark, f"{path}/part=*", "id bigint, di int")
    return r.groupBy(F.regexp_extract("shard", r"part=(\d+)", 1).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))


def append_twice(spark, d):
    """Rows appended in two runs and read back with how often each came."""
    q = load(spark, d, "questions").select("di", "origin").dropDuplicates(["di"])
    path = _path(spark, "appended")
    R.append_json_lines(q, path)
    R.append_json_lines(q.where("di % 2 = 0"), path)
    return spark.read.schema("di int, origin string").json(path).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("di").alias("n_ids"))


def fingerprints(spark, d):
    """SHA-256 of a whole file."""
    path = _array_file(spark, d)
    return R.file_hashes(spark, f"{path}/*.txt").select("sha256")


def merged_items(spark, d):
    """Two item sets with other columns as one, in the order of their index."""
    q = load(spark, d, "questions").where("di >= 0").dropDuplicates(["di"])
    a = q.where("di % 2 = 0").select(F.col("di").alias("dataset_index"), "db_id")
    b = q.where("di % 2 <> 0").select(F.col("di").alias("dataset_index"), "difficulty")
    return R.merge_items(a, b)


def checkpoint_states(spark, d):
    """Checkpoints held against their rules: completed indices are those of the items, none twice, one configuration."""
    q = load(spark, d, "questions").select("di", "origin", "db_id")
    return R.checkpoint_faults(q.select(F.col("origin").alias("run"), F.col("di").alias("dataset_index")), q.where("di % 4 <> 0").select(F.col("origin").alias("run"), F.col("di").alias("dataset_index")))


def store_round_trip(spark, d):
    """Early samples put into a store, then all of them: what was added and skipped, and what the store holds by model."""
    c = load(spark, d, "candidates").dropDuplicates(["id"])
    path = _path(spark, "store")
    first = ST.ingest(spark, path, c.where("seed <= 1"))
    second = ST.ingest(spark, path, c)
    held = spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return held.withColumn("added_first", F.lit(first["added"]).cast("bigint")).withColumn("added_then", F.lit(second["added"]).cast("bigint")).withColumn("total", F.lit(second["total"]).cast("bigint"))


def example_sources(spark, d):
    """Examples of two file shapes, chat messages and items with candidates, as one table of question and response."""
    q = load(spark, d, "questions").where("question is not null and di >= 0").dropDuplicates(["di"])
    r = load(spark, d, "responses").dropDuplicates(["response_id"]).where("trim(raw_response) <> ''").groupBy("di").agg(F.min_by("raw_response", "response_id").alias("t"))
    j = q.join(r, "di")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.to_json(F.struct(F.array(message("user", F.col("question")), message("assistant", F.col("t"))).alias("messages")))
    item = F.to_json(F.struct("question", "db_id", F.array(F.struct(F.col("t").alias("raw_response"), F.lit(True).alias("execution_success"), (F.col("di") % 3 != 0).alias("correct_vav"))).alias("candidates")))
    return R.example_entries(j.select(F.col("di").alias("idx"), F.when(F.col("di") % 2 == 0, chat).otherwise(item).alias("record")))


_F = (read_array, read_wrapped, read_metadata, read_lines, read_csv_latin, read_pairs, read_log, read_all_shards, append_twice, fingerprints, merged_items, checkpoint_states, store_round_trip, example_sources)
QUERIES = {f.__name__: f for f in _F}
KEY = "di, model, lora, temperature, seed, prompt_hash"
ARRAY = "'[' || string_agg('{\"item_id\":' || item_id || ',\"split_name\":' || to_json(split_name) || ',\"item_text\":' || to_json(item_text) || '}', ',' ORDER BY item_id, split_name, item_text) || ']'"
SQL = {
    "read_array": "SELECT * FROM (SELECT CAST(ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS INTEGER) AS dataset_index, item_id, split_name, item_text FROM eval_items) t WHERE dataset_index BETWEEN 20 AND 119",
    "read_wrapped": "SELECT shape, CAST(ROW_NUMBER() OVER (PARTITION BY shape ORDER BY item_id) - 1 AS INTEGER) AS pos, item_id FROM eval_items, (SELECT unnest(['array', 'object']) AS shape) s",
    "read_metadata": "SELECT db_id, CAST(len(table_names_original) AS INTEGER) AS n_tables, CAST(len(column_names_original) AS INTEGER) AS n_columns, column_names_original[2].column_name AS first_column, CAST(len(foreign_keys) AS INTEGER) AS n_links FROM db_schemas",
    "read_lines": "SELECT DISTINCT ON (id) id, di, model FROM candidates",
    "read_csv_latin": "SELECT db_id, 'größe-' || table_names_original[1] AS label FROM db_schemas",
    "read_pairs": "WITH q AS (SELECT di, min(db_id) AS db_id FROM questions WHERE gold_sql IS NOT NULL AND di >= 0 GROUP BY di), g AS (SELECT *, ROW_NUMBER() OVER (ORDER BY di) - 1 AS line FROM q), p AS (SELECT COUNT(*) AS n FROM q WHERE di % 10 <> 9) SELECT db_id, line >= p.n AS missing, COUNT(*) AS n, MIN(line) AS first_line, MAX(line) AS last_line FROM g, p GROUP BY 1, 2",
    "read_log": "SELECT CAST(event_id % 7 AS INTEGER) AS epoch, COUNT(*) AS n, ROUND(MIN(ROUND(value, 3)), 3) AS low, ROUND(MAX(ROUND(value, 3)), 3) AS high FROM events GROUP BY 1",
    "read_all_shards": "SELECT CAST(id % 4 AS INTEGER) AS part, COUNT(*) AS n, MIN(id) AS low FROM (SELECT DISTINCT ON (id) id FROM candidates) t GROUP BY 1",
    "append_twice": "SELECT origin, CAST(SUM(CASE WHEN di % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n, COUNT(*) AS n_ids FROM (SELECT DISTINCT ON (di) di, origin FROM questions) q GROUP BY 1",
    "fingerprints": f"SELECT sha256(({ARRAY}) || chr(10)) AS sha256 FROM eval_items",
    "merged_items": "SELECT di AS dataset_index, CASE WHEN di % 2 = 0 THEN db_id END AS db_id, CASE WHEN di % 2 <> 0 THEN difficulty END AS difficulty FROM (SELECT DISTINCT ON (di) * FROM questions) q WHERE di >= 0",
    "checkpoint_states": "WITH a AS (SELECT origin AS run, di, COUNT(*) AS n FROM questions GROUP BY 1, 2), b AS (SELECT origin AS run, di, COUNT(*) AS n FROM questions WHERE di % 4 <> 0 GROUP BY 1, 2) SELECT a.run, CAST(SUM(CASE WHEN a.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_indices, CAST(SUM(CASE WHEN b.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_items, COUNT(*) - COUNT(b.di) AS without_item, CAST(0 AS BIGINT) AS without_index FROM a LEFT JOIN b ON a.run = b.run AND a.di = b.di GROUP BY a.run",
    "store_round_trip": f"WITH c AS (SELECT DISTINCT ON (id) * FROM candidates), k AS (SELECT {KEY}, MIN(seed) AS s0 FROM c GROUP BY ALL), m AS (SELECT model, COUNT(*) AS n FROM k GROUP BY 1) SELECT model, n, (SELECT COUNT(*) FROM k WHERE seed <= 1) AS added_first, (SELECT COUNT(*) FROM k WHERE NOT COALESCE(seed <= 1, FALSE)) AS added_then, (SELECT COUNT(*) FROM k) AS total FROM m",
    "example_sources": "WITH q AS (SELECT DISTINCT ON (di) di, question, db_id FROM questions WHERE question IS NOT NULL AND di >= 0), r AS (SELECT di, arg_min(raw_response, response_id) AS t FROM responses WHERE trim(raw_response, ' ') <> '' GROUP BY di) SELECT di AS idx, question, t AS response, CASE WHEN di % 2 <> 0 THEN db_id END AS db_id, CASE WHEN di % 2 = 0 THEN 'messages' ELSE 'items' END AS kind FROM q JOIN r USING (di) WHERE di % 2 = 0 OR di % 3 <> 0",
}
