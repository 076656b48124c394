"""Queries over the candidate pool, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import Window as W

from quorumframe.operators import pool as P
from quorumframe.session import load, written

from . import fixture as X

POOL = """
pool AS (SELECT user_id AS qid, event_id AS sample_idx, CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(FLOOR(value / 50) AS INT) END AS res_cell,
  CASE WHEN event_type = 'error' THEN 'err' WHEN event_type = 'signup' THEN 'none' ELSE 'ok' END AS status,
  CONCAT('SELECT  ', UPPER(event_type), ' ', CAST(CAST(FLOOR(value / 50) AS INT) AS VARCHAR)) AS sql_text FROM events),
entries AS (SELECT qid, lower(trim(regexp_replace(sql_text, '\\s+', ' ', 'g'))) AS key, COUNT(*) AS votes, MIN(sample_idx) AS min_idx,
  arg_min(sql_text, sample_idx) AS sql_text, list_sort(list_distinct(list(model))) AS models, MAX(res_cell) AS res_cell, MAX(status) AS status FROM pool GROUP BY 1, 2),
scored AS (SELECT *, ROUND((min_idx * 7919 % 1000) / 1000.0, 3)::DOUBLE AS score,
  [CASE WHEN status = 'err' THEN 'ERROR' WHEN status = 'none' THEN 'E' ELSE 'I' || CAST((res_cell + qid * k) % 7 AS VARCHAR) END FOR k IN [0, 1, 2]] AS vector FROM entries),
groups AS (SELECT qid, array_to_string(vector, '|') AS sig, CAST(SUM(votes) AS BIGINT) AS size, COUNT(*) AS n_keys, len(list_distinct(flatten(list(models)))) AS n_models,
  arg_min(key, {'i': min_idx, 'k': key}) AS rep, MIN(min_idx) AS rep_idx, arg_min(score, {'i': min_idx, 'k': key}) AS score, MAX(score) AS best_score, ROUND(AVG(score), 6) AS mean_score,
  bool_and(status = 'none') AS is_empty, bool_and(status <> 'none' AND array_to_string(vector, '|') = 'I0|I0|I0') AS is_zero
  FROM scored WHERE status <> 'err' GROUP BY qid, vector),
rankable AS (SELECT * FROM (SELECT *, MAX(CASE WHEN is_empty OR is_zero THEN 0 ELSE 1 END) OVER (PARTITION BY qid) AS any_fine FROM groups) t WHERE any_fine = 0 OR NOT (is_empty OR is_zero))
"""


def winner_sql(order: str, source: str = "rankable") -> str:
    return f"WITH {POOL} SELECT qid, rep, size, sig FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY {order}, sig DESC) AS rn FROM {source}) t WHERE rn = 1"


LOGIT = "ln(greatest(0.000001, least(0.999999, score)) / (1 - greatest(0.000001, least(0.999999, score))))"


def tier_sql(t: float) -> str:
    return winner_sql(f"NOT (is_empty OR is_zero) DESC, ROUND(size * (1 / (1 + exp(-{LOGIT} / {t}))), 6) DESC, size DESC", "groups")


CLOSE = "(s1 < 2 OR (s2 IS NOT NULL AND s1 - s2 <= 1))"
TOPS = "tops AS (SELECT qid, MAX(CASE WHEN rn = 1 THEN size END) AS s1, MAX(CASE WHEN rn = 2 THEN size END) AS s2, MAX(CASE WHEN rn = 1 THEN score END) AS p1, MAX(CASE WHEN rn = 2 THEN score END) AS p2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, sig DESC) AS rn FROM rankable) t GROUP BY qid)"
ARM_SQL = {
    "vav": winner_sql("size DESC"),
    "soft_cross_w1": winner_sql("size + 1 * n_models DESC"),
    "soft_cross_w2": winner_sql("size + 2 * n_models DESC"),
    "soft_cross_w3": winner_sql("size + 3 * n_models DESC"),
    "soft_ladder": winner_sql("(n_models > 1) DESC, size DESC"),
    "grouphead": winner_sql("ROUND(size * score, 6) DESC, size DESC"),
    "hybrid": winner_sql("ROUND(CAST(size AS DOUBLE) / top_size * score, 6) DESC", "(SELECT *, MAX(size) OVER (PARTITION BY qid) AS top_size FROM groups)"),
    "tier_temp_half": tier_sql(0.5),
    "tier_temp_1": tier_sql(1.0),
    "tier_temp_2": tier_sql(2.0),
    "r3": winner_sql("beaten DESC, ROUND(size * mean_score, 6) DESC, size DESC", "(SELECT a.*, (SELECT COUNT(*) FROM rankable b WHERE b.qid = a.qid AND b.mean_score <= a.mean_score - 0.05 - 1e-9) AS beaten FROM rankable a)"),
    "vote_rate": winner_sql("ROUND(CAST(size AS DOUBLE) * size / all_votes, 6) DESC", "(SELECT r.*, t.all_votes FROM rankable r JOIN (SELECT qid, SUM(size) AS all_votes FROM groups GROUP BY qid) t USING (qid))"),
    "soft_mean": winner_sql("ROUND(size * mean_score, 6) DESC"),
    "cascade_2": winner_sql("ROUND(size * score, 6) DESC", "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(size * mean_score, 6) DESC, sig DESC) AS r1 FROM rankable) q WHERE r1 <= 2)"),
    "cascade_4": winner_sql("ROUND(size * score, 6) DESC", "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(size * mean_score, 6) DESC, sig DESC) AS r1 FROM rankable) q WHERE r1 <= 4)"),
    "tiebreak": f"WITH {POOL}, {TOPS} SELECT qid, rep, size, sig FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.qid ORDER BY size DESC, sig DESC) AS rn, CASE WHEN {CLOSE} AND COALESCE(p2 > p1, FALSE) THEN 2 ELSE 1 END AS want FROM rankable r JOIN tops USING (qid)) t WHERE rn = want",
    "gated": winner_sql(f"CASE WHEN {CLOSE} THEN CAST(n_models > 1 AS INT) END DESC NULLS LAST, size DESC, CASE WHEN {CLOSE} THEN -len(regexp_extract_all(lower(regexp_replace(rep, '''[^'']*''', '', 'g')), '\\bjoin\\b')) END DESC NULLS LAST", "(SELECT r.*, s1, s2 FROM rankable r JOIN tops USING (qid))").replace(f"WITH {POOL}", f"WITH {POOL}, {TOPS}"),
    "p03": f"WITH {POOL}, {TOPS}, b AS (SELECT r.*, {CLOSE} AS close, FIRST_VALUE(n_models) OVER w AS bm, FIRST_VALUE(size) OVER w AS bs, ROW_NUMBER() OVER w AS place, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY n_models DESC, size DESC, sig DESC) AS wide FROM rankable r JOIN tops USING (qid) WINDOW w AS (PARTITION BY qid ORDER BY size DESC, sig DESC)), c AS (SELECT qid, bool_or(close AND wide = 1 AND (n_models > bm OR n_models = bm AND size > bs)) AS change FROM b GROUP BY qid) SELECT qid, rep, size, sig FROM b JOIN c USING (qid) WHERE CASE WHEN change THEN wide = 1 ELSE place = 1 END",
}
MAJ = "maj AS (SELECT qid, key AS rep, votes AS size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, min_idx) AS rn FROM scored) t WHERE rn = 1)"
VAV = "vav AS (SELECT qid, rep, size, sig FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, sig DESC) AS rn FROM rankable) t WHERE rn = 1)"
GOLD = "('I' || CAST((qid % 5) % 7 AS VARCHAR) || '|I' || CAST((qid % 5 + qid) % 7 AS VARCHAR) || '|I' || CAST((qid % 5 + qid * 2) % 7 AS VARCHAR))"


def _arm_query(name):
    def query(spark, d):
        return P.ARMS[name](P.build_groups(X.entries_of(spark, d)))

    query.__doc__ = f"Winners of the {name} rule."
    return query


def dedupe_candidates(spark, d):
    """Distinct query texts of each question with their votes."""
    return X.dedupe(X.event_pool(load(spark, d, "events"))).select("qid", "key", "votes", "min_idx", "sql_text", F.array_join("models", ",").alias("models"))


def groups_by_signature(spark, d):
    """Groups of equal result vectors."""
    return P.build_groups(X.entries_of(spark, d)).select("qid", "sig", "size", "n_keys", "n_models", "rep", "is_empty", "is_zero")


def rankable_groups(spark, d):
    """Groups that may win."""
    return P.rankable(P.build_groups(X.entries_of(spark, d))).select("qid", "sig", "size")


def multi_instance_vector(spark, d):
    """Signature vector of each candidate over three instances."""
    return X.entries_of(spark, d).select("qid", "key", F.array_join("vector", "|").alias("sig"))


def maj_winner(spark, d):
    """Majority text of each question."""
    return P.majority(X.entries_of(spark, d))


def argmax_winner(spark, d):
    """Highest-scored candidate of each question."""
    return P.argmax_score(X.entries_of(spark, d).where("status <> 'err'"))


def fallback_chain(spark, d):
    """Winner of the vote, else the majority text, else a constant query."""
    e = X.entries_of(spark, d)
    return P.with_fallback(X.event_pool(load(spark, d, "events")), P.arm_vav(P.build_groups(e)), P.majority(e))


def winner_judged(spark, d):
    """Whether the vote's winner has the gold result in all instances."""
    e = X.entries_of(spark, d)
    return X.judged(P.arm_vav(P.build_groups(e)), e)


def pool_membership(spark, d):
    """Winners of the vote in the pools of one model, the other, and both."""
    out = None
    for name, model in (("m1", "m1"), ("m2", "m2"), ("both", None)):
        w = P.arm_vav(P.build_groups(X.entries_of(spark, d, model))).select(F.lit(name).alias("pool"), "qid", "sig", "size")
        out = w if out is None else out.unionByName(w)
    return out


def instance_ladder(spark, d):
    """Winners of the vote on the first one, two and three instances."""
    out = None
    for k in (1, 2, 3):
        w = P.arm_vav(P.build_groups(X.entries_of(spark, d, instances=k))).select(F.lit(k).alias("k"), "qid", "sig", "size")
        out = w if out is None else out.unionByName(w)
    return out


def order_split(spark, d):
    """Groups that fall apart when the order of samples matters (the parity of the cell stands for the order)."""
    e = X.entries_of(spark, d).where("status = 'ok'").withColumn("ordered", F.col("res_cell") % 2)
    g = e.groupBy("qid", F.array_join("vector", "|").alias("sig")).agg(F.countDistinct("ordered").alias("n_orders"), F.sum("votes").alias("size"))
    return g.where("n_orders > 1")


def vote_shortest(spark, d):
    """The largest group, first seen on ties, and the shortest query in it."""
    e = X.entries_of(spark, d).where("status <> 'err'").withColumn("sig", F.array_join("vector", "|"))
    g = e.groupBy("qid", "sig").agg(F.sum("votes").alias("size"), F.min("min_idx").alias("first"), F.min_by("key", F.struct(F.length("key").alias("n"), "key")).alias("rep"))
    best = g.groupBy("qid").agg(F.max_by(F.struct("rep", "size"), F.struct(F.col("size"), -F.col("first"))).alias("w"))
    return best.select("qid", "w.rep", "w.size")


def vote_prefer_source(spark, d):
    """The text with most votes; on ties one that model m1 gave, then the earliest, then the shortest."""
    e = X.entries_of(spark, d)
    key = F.struct(F.col("votes"), F.array_contains("models", "m1"), -F.col("min_idx"))
    return e.groupBy("qid").agg(F.max_by(F.struct("key", "votes"), key).alias("w")).select("qid", F.col("w.key").alias("rep"), F.col("w.votes").alias("size"))


def vote_min_votes(spark, d):
    """Winners whose group has at least 8 votes."""
    return P.arm_vav(P.build_groups(X.entries_of(spark, d))).where("size >= 8")


def vote_keep_empty(spark, d):
    """The vote with empty groups kept in."""
    return P.pick(P.build_groups(X.entries_of(spark, d)), F.col("size"))


def vote_quality(spark, d):
    """Votes first, then the quality of the text: fewer words, then shorter."""
    e = X.entries_of(spark, d).where("status <> 'err'")
    quality = F.round(-2.0 * F.size(F.split("key", " ")) - 0.001 * F.length("key"), 6)
    w = e.groupBy("qid").agg(F.max_by(F.struct("key", "votes"), F.struct(F.col("votes"), quality, F.col("key"))).alias("w"))
    return w.select("qid", F.col("w.key").alias("rep"), F.col("w.votes").alias("size"))


def source_ablation(spark, d):
    """Winners over each subset of models; votes are not counted again by model."""
    e = X.entries_of(spark, d)
    out = None
    for tags in (("m1",), ("m2",), ("m1", "m2")):
        sub = e.where(F.arrays_overlap("models", F.array(*map(F.lit, tags))))
        w = P.arm_vav(P.build_groups(sub)).select(F.lit("+".join(tags)).alias("subset"), "qid", "sig", "size")
        out = w if out is None else out.unionByName(w)
    return out


def confidence_flags(spark, d):
    """Share of all samples that voted for the winner, low below 0.2 (strictly)."""
    n = X.event_pool(load(spark, d, "events")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    w = P.arm_vav(P.build_groups(X.entries_of(spark, d)))
    return w.join(n, "qid").select("qid", F.round(F.col("size") / F.col("n"), 6).alias("confidence"), (F.col("size") / F.col("n") < 0.2).alias("low"))


def centroid_filter(spark, d):
    """Candidates left when each question drops its quarter of least mean similarity.

    Similarity of two candidates: 1 over 1 plus the distance of their cells. The
    mean is taken from the counts of each distinct cell of the question (at most
    ten here), not from all pairs of candidates.
    """
    e = X.entries_of(spark, d).where("status = 'ok'").select("qid", "key", "res_cell", "min_idx")
    cells = e.groupBy("qid", "res_cell").agg(F.count(F.lit(1)).alias("n"))
    b = cells.select("qid", F.col("res_cell").alias("other"), F.col("n").alias("n_other"))
    sim = cells.join(b, "qid").groupBy("qid", "res_cell").agg(F.sum(F.col("n_other") / (1 + F.abs(F.col("res_cell") - F.col("other")))).alias("total"), F.sum("n_other").alias("k"))
    scored = e.join(sim, ["qid", "res_cell"]).where("k > 1").withColumn("mean_sim", F.round((F.col("total") - 1) / (F.col("k") - 1), 6))
    w = W.partitionBy("qid").orderBy("mean_sim", "min_idx")
    drop = F.greatest(F.lit(1), F.least(F.col("k") - 1, F.round(F.col("k") * 0.25)))
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") > drop).select("qid", "key", "mean_sim")


def accuracy_matrix(spark, d):
    """Accuracy of each rule over all questions."""
    e = X.entries_of(spark, d)
    gold = F.concat_ws("|", *[F.concat(F.lit("I"), ((F.col("qid") % 5 + F.col("qid") * k) % 7).cast("string")) for k in range(3)])
    return P.all_winners(written(P.build_groups(e), "groups", spark)).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("sig") == gold).cast("bigint")).alias("n_correct"))


QUERIES = {f"{k}_winner" if k == "vav" else f"arm_{k}": _arm_query(k) for k in P.ARMS}
QUERIES |= {f.__name__: f for f in (dedupe_candidates, groups_by_signature, rankable_groups, multi_instance_vector, maj_winner, argmax_winner, fallback_chain, winner_judged, pool_membership, instance_ladder, order_split, vote_shortest, vote_prefer_source, vote_min_votes, vote_keep_empty, vote_quality, source_ablation, confidence_flags, centroid_filter, accuracy_matrix)}


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _sub_pool(where: str) -> str:
    return POOL.replace("FROM events)", f"FROM events WHERE {where})")


def _k_sql(k: int) -> str:
    p = POOL.replace("[0, 1, 2]", str(list(range(k)))).replace("'I0|I0|I0'", "'" + "|".join(["I0"] * k) + "'")
    return f"SELECT CAST({k} AS INTEGER) AS k, qid, sig, size FROM (WITH {p}, {VAV} SELECT * FROM vav)"


SQL = {f"{k}_winner" if k == "vav" else f"arm_{k}": v for k, v in ARM_SQL.items()}
SQL |= {
    "dedupe_candidates": _with(POOL, "SELECT qid, key, votes, min_idx, sql_text, array_to_string(models, ',') AS models FROM entries"),
    "groups_by_signature": _with(POOL, "SELECT qid, sig, size, n_keys, CAST(n_models AS INTEGER) AS n_models, rep, is_empty, is_zero FROM groups"),
    "rankable_groups": _with(POOL, "SELECT qid, sig, size FROM rankable"),
    "multi_instance_vector": _with(POOL, "SELECT qid, key, array_to_string(vector, '|') AS sig FROM scored"),
    "maj_winner": _with(f"{POOL}, {MAJ}", "SELECT qid, rep, size FROM maj"),
    "argmax_winner": _with(POOL, "SELECT qid, key AS rep, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, min_idx) AS rn FROM scored WHERE status <> 'err') t WHERE rn = 1"),
    "fallback_chain": _with(f"{POOL}, {MAJ}, {VAV}", "SELECT q.qid, COALESCE(v.rep, m.rep, 'SELECT 1') AS rep, CASE WHEN v.rep IS NOT NULL THEN 'group' WHEN m.rep IS NOT NULL THEN 'fallback_maj' ELSE 'no_pool' END AS source FROM (SELECT DISTINCT qid FROM pool) q LEFT JOIN vav v USING (qid) LEFT JOIN maj m USING (qid)"),
    "winner_judged": _with(f"{POOL}, {VAV}", f"SELECT qid, rep, COALESCE(sig = {GOLD}, FALSE) AS correct FROM vav"),
    "pool_membership": " UNION ALL ".join(f"SELECT '{n}' AS pool, qid, sig, size FROM (WITH {_sub_pool(c)}, {VAV} SELECT * FROM vav)" for n, c in (("m1", "event_id % 2 = 0"), ("m2", "event_id % 2 <> 0"), ("both", "TRUE"))),
    "instance_ladder": " UNION ALL ".join(_k_sql(k) for k in (1, 2, 3)),
    "order_split": _with(POOL, "SELECT qid, array_to_string(vector, '|') AS sig, COUNT(DISTINCT res_cell % 2) AS n_orders, CAST(SUM(votes) AS BIGINT) AS size FROM scored WHERE status = 'ok' GROUP BY 1, 2 HAVING COUNT(DISTINCT res_cell % 2) > 1"),
    "vote_shortest": _with(POOL, "SELECT qid, rep, size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, f) AS rn FROM (SELECT qid, CAST(SUM(votes) AS BIGINT) AS size, MIN(min_idx) AS f, arg_min(key, {'n': LENGTH(key), 'k': key}) AS rep FROM scored WHERE status <> 'err' GROUP BY qid, vector) g) t WHERE rn = 1"),
    "vote_prefer_source": _with(POOL, "SELECT qid, key AS rep, votes AS size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, list_contains(models, 'm1') DESC, min_idx) AS rn FROM scored) t WHERE rn = 1"),
    "vote_min_votes": _with(f"{POOL}, {VAV}", "SELECT qid, rep, size, sig FROM vav WHERE size >= 8"),
    "vote_keep_empty": winner_sql("size DESC", "groups"),
    "vote_quality": _with(POOL, "SELECT qid, key AS rep, votes AS size FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, ROUND(-2.0 * len(string_split(key, ' ')) - 0.001 * LENGTH(key), 6) DESC, key DESC) AS rn FROM scored WHERE status <> 'err') t WHERE rn = 1"),
    "source_ablation": " UNION ALL ".join(f"SELECT '{n}' AS subset, qid, sig, size FROM (WITH {POOL.replace(chr(39) + 'err' + chr(39) + ' GROUP BY qid, vector', chr(39) + 'err' + chr(39) + ' AND ' + c + ' GROUP BY qid, vector')}, {VAV} SELECT * FROM vav)" for n, c in (("m1", "list_contains(models, 'm1')"), ("m2", "list_contains(models, 'm2')"), ("m1+m2", "TRUE"))),
    "confidence_flags": _with(f"{POOL}, {VAV}", "SELECT qid, ROUND(CAST(size AS DOUBLE) / n, 6) AS confidence, CAST(size AS DOUBLE) / n < 0.2 AS low FROM vav JOIN (SELECT qid, COUNT(*) AS n FROM pool GROUP BY qid) t USING (qid)"),
    "centroid_filter": _with(POOL, "SELECT qid, key, mean_sim FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY mean_sim, min_idx) AS r FROM (SELECT a.qid, a.key, a.min_idx, ROUND((SUM(1.0::DOUBLE / (1 + ABS(a.res_cell - b.res_cell))) - 1) / (COUNT(*) - 1), 6) AS mean_sim, COUNT(*) AS k FROM scored a JOIN scored b ON a.qid = b.qid AND b.status = 'ok' WHERE a.status = 'ok' GROUP BY 1, 2, 3 HAVING COUNT(*) > 1) m) t WHERE r > GREATEST(1, LEAST(k - 1, ROUND(k * 0.25)))"),
    "accuracy_matrix": "SELECT arm, COUNT(*) AS n, CAST(SUM(CASE WHEN sig = " + GOLD + " THEN 1 ELSE 0 END) AS BIGINT) AS n_correct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS arm, qid, sig FROM ({v})" for k, v in ARM_SQL.items()) + ") t GROUP BY arm",
}
