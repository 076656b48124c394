"""The p queries of the llm operators with their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import load

from .dedup import Copies
from .leakage import leaked_spans
from .packing import fill_report, pack
from .pairs import defective_pairs
from .quality import structural_kind, text_quality
from .topn import top_n_per_group
from .truncation import cut_off, share_by_source, signals


def blank_trimmed(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Per question the three results of the highest vote."""
    c = load(spark, d, "candidates").select("di", F.lower(blank_trimmed(F.col("result_hash"))).alias("result_hash"), "vote")
    c = c.where("vote >= 0 and result_hash <> ''")
    return top_n_per_group(c, "di", "result_hash", "vote", 3).select("di", "result_hash", "rnk")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a query with the id that is kept."""
    return Copies(load(spark, d, "candidates"), spark).pairs()


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each distinct query with the number of its copies."""
    return Copies(load(spark, d, "candidates"), spark).records()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses that were cut off."""
    return cut_off(load(spark, d, "responses"), spark)


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts off."""
    r = load(spark, d, "responses")
    return share_by_source(r, cut_off(r, spark))


def p2_signals(spark: SparkSession, d: str) -> DataFrame:
    """What tells that a response was cut off: its structure, and a longer copy of the whole text."""
    return signals(load(spark, d, "responses"), spark)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective prompt and response pairs."""
    return defective_pairs(load(spark, d, "responses"), spark)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split, by window."""
    packed = pack(load(spark, d, "documents"), load(spark, d, "context_windows"), spark)
    return packed.where("n_pieces > 1").select("window_id", "doc_id").distinct()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of all texts and pieces to containers."""
    return pack(load(spark, d, "documents"), load(spark, d, "context_windows"), spark)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Unused room of the packing by window."""
    return fill_report(p6_packing(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they leak."""
    return leaked_spans(load(spark, d, "documents"), load(spark, d, "eval_items"), spark).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans to remove from the documents."""
    return leaked_spans(load(spark, d, "documents"), load(spark, d, "eval_items"), spark).distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no natural prose, with their kind."""
    return structural_kind(load(spark, d, "documents")).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Text figures of every document."""
    return text_quality(load(spark, d, "documents")).distinct()


def _queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


QUERIES = _queries()

# All windows of 12 words of the items, and those of the documents with their places.
_WINDOWS = """
w AS (SELECT 0 AS side, item_id AS id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS ws FROM eval_items UNION ALL SELECT 1, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM documents),
v AS (SELECT side, id, i, array_to_string(ws[i:i + 11], ' ') AS p FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w) t),
hit AS (SELECT DISTINCT d.id AS doc_id, e.id AS item_id, d.i FROM v d JOIN v e ON d.p = e.p WHERE d.side = 1 AND e.side = 0)
"""
SQL = {
    "p7_found": f"WITH {_WINDOWS} SELECT DISTINCT doc_id, item_id FROM hit",
    "p7_items": f"WITH {_WINDOWS} SELECT item_id, COUNT(DISTINCT doc_id) AS n_docs FROM hit GROUP BY item_id",
    "p7_spans": f"""WITH {_WINDOWS}, s AS (SELECT *, CASE WHEN i - LAG(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) <= 12 THEN 0 ELSE 1 END AS new FROM hit), g AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS n FROM s)
SELECT doc_id, item_id, MIN(i) - 1 AS first_word, MAX(i) + 10 AS last_word FROM g GROUP BY doc_id, item_id, n""",
    "p1_found": """
WITH c AS (SELECT di, lower(regexp_replace(result_hash, '^\\s+|\\s+$', '', 'g')) AS result_hash, vote FROM candidates WHERE vote >= 0),
b AS (SELECT di, result_hash, max(vote) AS s FROM c WHERE result_hash <> '' AND di IS NOT NULL GROUP BY di, result_hash),
r AS (SELECT di, result_hash, CAST(row_number() OVER (PARTITION BY di ORDER BY s DESC, result_hash DESC) AS INTEGER) AS rnk FROM b)
SELECT di, result_hash, rnk FROM r WHERE rnk <= 3
""",
    "p6_found": """
SELECT w.window_id, d.doc_id FROM documents d JOIN context_windows w ON strlen(d.text) + 1 > w.capacity_tokens WHERE d.text <> ''
""",
}
