"""Queries on result-set equality, signatures and partial scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.operators import equality as E
from quorumframe.session import load


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A gold and a predicted result for each order: its lines, changed in one of six ways by the order's key."""
    line = load(spark, d, "lineitem")
    row = F.array(E.cell(F.col("l_partkey") % 5, "I"), E.cell(F.col("l_suppkey") % 3, "I"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("row"))
    gold = line.groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("gold"))
    g, k = F.col("gold"), F.col("qid") % 6
    pred = (
        F.when(k == 1, F.reverse(g))
        .when(k == 2, F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))))
        .when(k == 3, F.concat(g, F.slice(g, 1, 1)))
        .when(k == 4, F.transform(g, lambda r: F.reverse(r)))
        .when(k == 5, F.concat(F.array(F.array(F.lit("I9"), F.lit("I9"))), F.slice(g, 2, 1 << 30)))
        .otherwise(g)
    )
    return gold.withColumn("pred", pred)


PAIRS = """
WITH g AS (SELECT l_orderkey AS qid, list(['I' || (l_partkey % 5)::VARCHAR, 'I' || (l_suppkey % 3)::VARCHAR] ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS gold FROM lineitem GROUP BY l_orderkey),
pairs AS (SELECT qid, gold, CASE qid % 6 WHEN 1 THEN list_reverse(gold) WHEN 2 THEN gold[1:len(gold) - 1] WHEN 3 THEN list_concat(gold, gold[1:1])
  WHEN 4 THEN [list_reverse(r) FOR r IN gold] WHEN 5 THEN list_concat([['I9', 'I9']], gold[2:]) ELSE gold END AS pred FROM g)
"""


def _rel(name: str, make):
    def query(spark, d):
        return pairs(spark, d).select("qid", make(F.col("gold"), F.col("pred")).alias("equal"))

    query.__doc__ = f"Result equality {name}."
    return query


RELATIONS = {
    "eq_ordered": (E.eq_ordered, "gold = pred"),
    "eq_multiset": (lambda a, b: E.eq_bag(a, b), "list_sort(gold) = list_sort(pred)"),
    "eq_order_aware": (lambda a, b: E.eq_bag(a, b, F.col("qid") % 2 == 1), "CASE WHEN qid % 2 = 1 THEN gold = pred ELSE list_sort(gold) = list_sort(pred) END"),
    "eq_set": (E.eq_set, "list_sort(list_distinct(gold)) = list_sort(list_distinct(pred))"),
    "eq_header_agnostic": (E.eq_text_set, "list_sort(list_distinct([list_sort([c[2:] FOR c IN r]) FOR r IN gold])) = list_sort(list_distinct([list_sort([c[2:] FOR c IN r]) FOR r IN pred]))"),
    "eq_first_rows": (lambda a, b: E.eq_prefix(a, b, 2), "gold[1:2] = pred[1:2]"),
    "eq_perm_ordered": (lambda a, b: E.eq_permuted(a, b, F.col("qid") % 2 == 1), "CASE WHEN qid % 2 = 1 THEN gold = pred OR gold = [list_reverse(r) FOR r IN pred] ELSE list_sort(gold) = list_sort(pred) OR list_sort(gold) = list_sort([list_reverse(r) FOR r IN pred]) END"),
    "eq_perm_tolerant": (lambda a, b: E.eq_permuted(a, b, F.lit(False)), "list_sort(gold) = list_sort(pred) OR list_sort(gold) = list_sort([list_reverse(r) FOR r IN pred])"),
}


def eq_rounded(spark, d):
    """Equality in order of numbers rounded to four digits."""
    o = load(spark, d, "orders")
    rows = lambda c: F.array(F.array(E.cell(F.col("o_orderkey"), "I"), E.cell(c, "F")))
    a, b = rows(F.col("o_totalprice")), rows(F.col("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 0.00001).otherwise(0.5))
    return o.select("o_orderkey", E.eq_rounded(a, b).alias("equal"))


def eq_column_keyed(spark, d):
    """Columns matched by key, a repeated key keeping its last column."""
    keys = lambda *k: F.array(*map(F.lit, k))
    p = pairs(spark, d)
    return p.select("qid", E.eq_keyed(F.col("gold"), keys("a", "b"), F.transform("pred", lambda r: F.reverse(r)), keys("b", "a")).alias("equal"))


def row_overlap(spark, d):
    """Share of gold rows found, as a bag and by place."""
    p = pairs(spark, d)
    return p.select("qid", E.row_overlap(F.col("pred"), F.col("gold")).alias("overlap"), E.row_overlap_ordered(F.col("pred"), F.col("gold")).alias("in_place"))


def signatures(spark, d):
    """Bag, order-aware, row-and-column-invariant and truncated signatures and the row hash."""
    ok = F.col("qid") % 11 != 0
    r = F.col("pred")
    return pairs(spark, d).select(
        "qid", E.sig_bag(ok, r).alias("bag"), E.sig_ordered(ok, r).alias("ordered"), E.sig_rci(ok, r).alias("rci"),
        E.sig_trunc200(ok, r, F.lit("syntax")).alias("text"), E.rows_hash(r).alias("hash"),
    )


def degenerate_vectors(spark, d):
    """Whether a vector of results over two instances is empty, or all zero."""
    p = pairs(spark, d)
    v = F.array(F.when(F.col("qid") % 4 == 0, F.slice("pred", 1, 0)).otherwise(F.filter("pred", lambda r: F.element_at(r, 1) == "I0")), F.slice("gold", 1, 0))
    return p.select("qid", E.vector_is_empty(v).alias("empty"), E.vector_is_all_zero(v).alias("zero"))


def diff_rows(spark, d):
    """Rows of lines that one month's result has and the other has not, as bags, with their side."""
    line = load(spark, d, "lineitem")
    a = line.where("l_linenumber = 1").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 5).alias("b"))
    b = line.where("l_linenumber = 2").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 5).alias("b"))
    side = lambda x, y, n: x.exceptAll(y).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(n))
    return side(a, b, "missing").unionByName(side(b, a, "extra"))


def soft_f1(spark, d):
    """Name-aware soft F1 of the predicted result."""
    p = pairs(spark, d)
    names = lambda *k: F.array(*map(F.lit, k))
    return p.select("qid", E.soft_f1_udf("pred", "gold", names("a", "b"), names("a", "b")).alias("f1"))


def reward_ladders(spark, d):
    """Rewards by each ladder."""
    p = pairs(spark, d)
    overlap = E.row_overlap(F.col("pred"), F.col("gold"))
    args = dict(ok=F.col("qid") % 13 != 0, gold_ok=F.col("qid") % 17 != 0, match=E.eq_bag(F.col("gold"), F.col("pred")), overlap=overlap, sim=F.round((F.col("qid") % 10) / 10.0, 2), truncated=F.col("qid") % 19 == 0, stub=F.col("qid") % 23 == 0)
    return p.select("qid", *[E.reward(k, **args).alias(k) for k in ("binary", "three_level", "partial", "atomic", "graded")])


def weighted_jaccard(spark, d):
    """Execution-weighted similarity of the token sets of two texts of each part."""
    p = load(spark, d, "part")
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    j = E.jaccard(a, b)
    return p.select("p_partkey", F.round(j, 6).alias("jaccard"), E.weighted_similarity((F.col("p_size") % 2).cast("double"), (F.col("p_size") % 10) / 10.0).alias("weighted"))


QUERIES = {k: _rel(k, f) for k, (f, _) in RELATIONS.items()}
QUERIES |= {f.__name__: f for f in (eq_rounded, eq_column_keyed, row_overlap, signatures, degenerate_vectors, diff_rows, soft_f1, reward_ladders, weighted_jaccard)}
OVERLAP = "list_sum([least(len(list_filter(pred, lambda x: x = r)), len(list_filter(gold, lambda x: x = r))) FOR r IN list_distinct(gold)])"
TXT = "list_sort(list_distinct([array_to_string(list_sort([c[2:] FOR c IN r]), '|') FOR r IN pred]))"
SQL = {k: f"{PAIRS} SELECT qid, {s} AS equal FROM pairs" for k, (_, s) in RELATIONS.items()}
SQL |= {
    "eq_rounded": "SELECT o_orderkey, o_orderkey % 2 = 0 AS equal FROM orders",
    "eq_column_keyed": f"{PAIRS} SELECT qid, gold = pred AS equal FROM pairs",
    "row_overlap": f"{PAIRS} SELECT qid, ROUND(CAST({OVERLAP} AS DOUBLE) / len(gold), 6) AS overlap, ROUND(CAST(len(list_filter(range(1, least(len(gold), len(pred)) + 1), lambda i: gold[i] = pred[i])) AS DOUBLE) / len(gold), 6) AS in_place FROM pairs",
    "signatures": f"""{PAIRS} SELECT qid, CASE WHEN qid % 11 <> 0 THEN array_to_string(list_sort([array_to_string(r, chr(31)) FOR r IN pred]), chr(30)) ELSE 'ERROR' END AS bag,
      CASE WHEN qid % 11 <> 0 THEN array_to_string([array_to_string(r, chr(31)) FOR r IN pred], chr(30)) ELSE 'ERROR' END AS ordered,
      CASE WHEN qid % 11 <> 0 THEN array_to_string(list_sort([array_to_string(list_sort(r), chr(31)) FOR r IN pred]), chr(30)) ELSE 'ERROR' END AS rci,
      CASE WHEN qid % 11 = 0 THEN 'ERROR: syntax' WHEN len(pred) = 0 THEN 'SUCCESS_VALUES:' ELSE substr(array_to_string({TXT}, ';'), 1, 200) END AS text,
      substr(sha256(array_to_string([array_to_string(r, chr(31)) FOR r IN pred], chr(30))), 1, 16) AS hash FROM pairs""",
    "degenerate_vectors": f"""{PAIRS}, v AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN [] ELSE list_filter(pred, lambda r: r[1] = 'I0') END AS rows FROM pairs)
      SELECT qid, len(rows) = 0 AS empty, len(rows) > 0 AND len(list_filter(flatten(rows), lambda c: c <> 'I0')) = 0 AS zero FROM v""",
    "diff_rows": """WITH a AS (SELECT l_partkey % 50 AS a, l_suppkey % 5 AS b, COUNT(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), b AS (SELECT l_partkey % 50 AS a, l_suppkey % 5 AS b, COUNT(*) AS n FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2)
      SELECT a.a, a.b, a.n - COALESCE(b.n, 0) AS n, 'missing' AS side FROM a LEFT JOIN b ON a.a = b.a AND a.b = b.b WHERE a.n > COALESCE(b.n, 0) UNION ALL SELECT b.a, b.b, b.n - COALESCE(a.n, 0), 'extra' FROM b LEFT JOIN a ON a.a = b.a AND a.b = b.b WHERE b.n > COALESCE(a.n, 0)""",
    "reward_ladders": f"""{PAIRS}, x AS (SELECT qid, qid % 13 <> 0 AS ok, qid % 17 <> 0 AS gok, list_sort(gold) = list_sort(pred) AS m, ROUND(CAST({OVERLAP} AS DOUBLE) / len(gold), 6) AS o, (qid % 10) / 10.0::DOUBLE AS s, qid % 19 = 0 OR qid % 23 = 0 AS bad FROM pairs)
      SELECT qid, """
    + ", ".join(f"ROUND(CASE WHEN bad OR NOT ok THEN 0.0 WHEN NOT gok THEN {n} WHEN m THEN 1.0 ELSE {e} END, 6)::DOUBLE AS {k}" for k, n, e in (("binary", "0.0", "0.0"), ("three_level", "0.1", "0.1"), ("partial", "0.2", "(CASE WHEN o > 0 THEN o ELSE 0.2 END)"), ("atomic", "0.0", "(0.3 + 0.7 * s)"), ("graded", "0.5", "(0.5 + 0.5 * s)")))
    + " FROM x",
    "weighted_jaccard": """WITH t AS (SELECT p_partkey, p_size, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
      SELECT p_partkey, ROUND(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, ROUND(0.05 * (p_size % 2) + 0.95 * 0.79 * pow((p_size % 10) / 10.0, 0.20), 6) AS weighted FROM t""",
}
