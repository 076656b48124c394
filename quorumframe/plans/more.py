"""Further selection rules and reports: result hashes, invariant signatures, consensus scores, grids and cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumframe.operators import equality as E
from quorumframe.operators import pool as P
from quorumframe.session import load

from . import fixture as X
from .adjudication import GOLD, POOL, VAV
from .curation import CAND


def _hashed(spark, d) -> DataFrame:
    """Executed candidates with their result hash in one writing."""
    c = load(spark, d, "candidates").select("id", "di", "model", "temperature", "seed", "sql_text", "exec_ok", "vote", F.lower(F.trim("result_hash")).alias("h"))
    return c.dropDuplicates(["id"]).where("exec_ok = 1 and h <> ''")


def vote_hash(spark, d):
    """The result with most candidates, first seen on ties, and the shortest query that gives it."""
    g = _hashed(spark, d).groupBy("di", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min_by("id", F.struct(F.coalesce(F.length("sql_text"), F.lit(1 << 30)).alias("l"), "id")).alias("rep"))
    best = g.groupBy("di").agg(F.max_by(F.struct("h", "n", "rep"), F.struct(F.col("n"), -F.col("first"))).alias("w"))
    return best.select("di", F.col("w.h").alias("result_hash"), F.col("w.n").alias("votes"), F.col("w.rep").alias("rep"))


def low_temp_vote(spark, d):
    """The most common result among the samples of temperature 0.2 and less."""
    g = _hashed(spark, d).where("temperature <= 0.2").groupBy("di", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return g.groupBy("di").agg(F.max_by("h", F.struct(F.col("n"), -F.col("first"))).alias("result_hash"))


def temp_grid(spark, d):
    """Agreement of the majority with the best-voted result, by temperature and number of samples."""
    s = _hashed(spark, d)
    best = s.where("vote is not null").groupBy("di").agg(F.max_by("h", F.struct("vote", "h")).alias("top"))
    # One row a sample and number; a question's samples of one temperature are counted, not sorted, within a bounded heap.
    first = s.groupBy("di", "temperature").agg(P.heap(F.struct("id", "h"), 8, True).alias("xs"))
    k = F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))).alias("k")
    x = first.select("di", "temperature", "xs", k).select("di", "temperature", "k", F.posexplode(F.slice("xs", F.lit(1), F.col("k"))).alias("p", "x"))
    v = x.groupBy("di", "temperature", "k", F.col("x.h").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    m = v.groupBy("di", "temperature", "k").agg(F.max_by("h", F.struct(F.col("n"), -F.col("first"))).alias("maj"))
    return m.join(best, "di").groupBy("temperature", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("maj") == F.col("top")).cast("double")), 6).alias("agree"))


def _with_rows(spark, d) -> DataFrame:
    """Entries with a result of two columns whose order turns with the votes."""
    e = X.entries_of(spark, d).where("status = 'ok'")
    a, b = F.concat(F.lit("I"), (F.col("res_cell") % 7).cast("string")), F.concat(F.lit("I"), ((F.col("res_cell") + F.col("qid")) % 3).cast("string"))
    return e.withColumn("rows", F.array(F.when(F.col("votes") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a))))


def arm_rci(spark, d):
    """Winner by signatures that ignore the order of rows and columns."""
    g = _with_rows(spark, d).withColumn("sig", E.sig_rci(F.lit(True), F.col("rows"))).groupBy("qid", "sig").agg(F.sum("votes").alias("size"), F.min_by("key", F.struct("min_idx", "key")).alias("rep"))
    return P.pick(g, F.col("size"), columns=("rep", "size", "sig")).select("qid", "rep", "size", F.regexp_replace("sig", "\x1f", ",").alias("sig"))


def arm_consensus_f1(spark, d):
    """Winner by mean soft F1 to the largest group's result, then by votes."""
    e = _with_rows(spark, d)
    top = e.groupBy("qid").agg(F.max_by("rows", F.struct("votes", "key")).alias("consensus"))
    names = F.array(F.lit("a"), F.lit("b"))
    s = e.join(top, "qid").withColumn("f1", E.soft_f1_udf("rows", "consensus", names, names))
    return s.groupBy("qid").agg(F.max_by(F.struct("key", "f1"), F.struct("f1", "votes", "key")).alias("w")).select("qid", F.col("w.key").alias("rep"), F.col("w.f1").alias("f1"))


def label_crosscheck(spark, d):
    """Labels of two ways to judge a winner: consistent, differing or missing on one side."""
    e = X.entries_of(spark, d)
    a = X.judged(P.arm_vav(P.build_groups(e)), e).select("qid", F.col("correct").alias("a"))
    b = X.judged(P.majority(e).select("qid", "rep"), e).select("qid", F.col("correct").alias("b"))
    j = a.join(b, "qid", "full")
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "consistent").otherwise("mismatch")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def empty_reasons(spark, d):
    """Why responses have no query, most frequent first."""
    r = load(spark, d, "responses").select("response_id", "sql", "parse_method").dropDuplicates(["response_id"]).where("sql is null or trim(sql) = ''")
    return r.groupBy(F.coalesce("parse_method", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10)


QUERIES = {f.__name__: f for f in (vote_hash, low_temp_vote, temp_grid, arm_rci, arm_consensus_f1, label_crosscheck, empty_reasons)}
HASHED = f"{CAND}, h AS (SELECT id, di, temperature, sql_text, vote, lower(trim(result_hash, ' ')) AS h FROM c WHERE exec_ok = 1 AND trim(result_hash, ' ') <> '')"
JUDGED = f"va AS (SELECT qid, COALESCE(sig = {GOLD}, FALSE) AS a FROM vav), mb AS (SELECT m.qid, COALESCE(array_to_string(m.vector, '|') = {GOLD.replace('qid', 'm.qid')}, FALSE) AS b FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, min_idx) AS rn FROM scored) m WHERE rn = 1)"
SQL = {
    "vote_hash": f"WITH {HASHED}, g AS (SELECT di, h, COUNT(*) AS n, MIN(id) AS f, arg_min(id, {{'l': COALESCE(length(sql_text), 1073741824), 'i': id}}) AS rep FROM h GROUP BY 1, 2) SELECT di, h AS result_hash, n AS votes, rep FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY di ORDER BY n DESC, f) AS r FROM g) t WHERE r = 1",
    "low_temp_vote": f"WITH {HASHED}, g AS (SELECT di, h, COUNT(*) AS n, MIN(id) AS f FROM h WHERE temperature <= 0.2 GROUP BY 1, 2) SELECT di, h AS result_hash FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY di ORDER BY n DESC, f) AS r FROM g) t WHERE r = 1",
    "temp_grid": f"WITH {HASHED}, b AS (SELECT di, arg_max(h, {{'v': vote, 'h': h}}) AS top FROM h WHERE vote IS NOT NULL GROUP BY 1), p AS (SELECT di, temperature, h, ROW_NUMBER() OVER (PARTITION BY di, temperature ORDER BY id) AS rn FROM h), v AS (SELECT di, temperature, k, h, COUNT(*) AS n, MIN(rn) AS f FROM p, (SELECT unnest([2, 4, 8]) AS k) ks WHERE rn <= k GROUP BY ALL), m AS (SELECT di, temperature, k, h AS maj FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY di, temperature, k ORDER BY n DESC, f) AS r FROM v) t WHERE r = 1) SELECT temperature, CAST(k AS INTEGER) AS k, COUNT(*) AS n, ROUND(AVG((maj = top)::INT::DOUBLE), 6) AS agree FROM m JOIN b USING (di) GROUP BY 1, 2",
    "arm_rci": f"WITH {POOL}, x AS (SELECT qid, key, votes, min_idx, array_to_string(list_sort(['I' || (res_cell % 7)::VARCHAR, 'I' || ((res_cell + qid) % 3)::VARCHAR]), ',') AS sig FROM scored WHERE status = 'ok'), g AS (SELECT qid, sig, CAST(SUM(votes) AS BIGINT) AS size, arg_min(key, {{'i': min_idx, 'k': key}}) AS rep FROM x GROUP BY 1, 2) SELECT qid, rep, size, sig FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, sig DESC) AS r FROM g) t WHERE r = 1",
    "label_crosscheck": f"WITH {POOL}, {VAV}, {JUDGED} SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = b THEN 'consistent' ELSE 'mismatch' END AS state, COUNT(*) AS n FROM va FULL JOIN mb USING (qid) GROUP BY 1",
    "empty_reasons": "WITH r AS (SELECT DISTINCT ON (response_id) * FROM responses) SELECT COALESCE(parse_method, 'none') AS reason, COUNT(*) AS n FROM r WHERE sql IS NULL OR trim(sql, ' ') = '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10",
    "arm_consensus_f1": f"WITH {POOL}, x AS (SELECT qid, key, votes, CASE WHEN votes % 2 = 0 THEN a ELSE b END AS p, CASE WHEN votes % 2 = 0 THEN b ELSE a END AS q FROM (SELECT qid, key, votes, res_cell % 7 AS a, (res_cell + qid) % 3 AS b FROM scored WHERE status = 'ok') t), c AS (SELECT qid, arg_max(p, {{'v': votes, 'k': key}}) AS cp, arg_max(q, {{'v': votes, 'k': key}}) AS cq FROM x GROUP BY qid), f AS (SELECT x.*, ((p = cp)::INT + (q = cq)::INT) / 2.0::DOUBLE AS f1 FROM x JOIN c USING (qid)) SELECT qid, key AS rep, f1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY f1 DESC, votes DESC, key DESC) AS rn FROM f) t WHERE rn = 1",
}
