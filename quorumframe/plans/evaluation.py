"""Queries on evaluation statistics, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumframe.operators import pool as P
from quorumframe.operators import stats as S
from quorumframe.session import load

from . import fixture as X
from .adjudication import ARM_SQL, CLOSE, GOLD, MAJ, POOL, TOPS, VAV

KS = [4, 8, 16, 32]


def _first(pool, by, columns):
    """The first samples of each group in order, at most the largest of KS: a bounded heap, however many a group has."""
    kept = pool.groupBy(*by).agg(P.heap(F.struct("sample_idx", *columns), max(KS), True).alias("xs"))
    return kept.select(*by, F.posexplode("xs").alias("p", "x")).select(*by, (F.col("p") + 1).alias("rn"), *[f"x.{c}" for c in columns])


def _samples(spark, d):
    """The first samples of each question in order with their result and whether it is right."""
    p = X.event_pool(load(spark, d, "events"))
    right = F.coalesce(F.col("res_cell") == F.col("qid") % 5, F.lit(False))
    return _first(p.withColumn("res", F.coalesce(F.col("res_cell").cast("string"), F.lit("err"))).withColumn("correct", right), ["qid"], ["res", "correct"])


SAMPLES = "samples AS (SELECT user_id AS qid, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, COALESCE(CASE WHEN event_type <> 'error' THEN CAST(CAST(FLOOR(value / 50) AS INT) AS VARCHAR) END, 'err') AS res, COALESCE(CASE WHEN event_type <> 'error' THEN CAST(FLOOR(value / 50) AS INT) = user_id % 5 END, FALSE) AS correct FROM events)"


def _judged(spark, d):
    e = X.entries_of(spark, d)
    g = P.build_groups(e)
    return X.judged(P.arm_vav(g), e), X.judged(P.majority(e).select("qid", "rep"), e)


def run_summary(spark, d):
    """Counts and rates over responses."""
    return S.run_summary(load(spark, d, "responses").dropDuplicates(["response_id"]))


def fixed_broken(spark, d):
    """Majority against the vote: fixed, broken and net."""
    vav, maj = _judged(spark, d)
    return S.paired(maj, vav)


def mcnemar_counts(spark, d):
    """Discordant pairs of the two runs with the exact test."""
    vav, maj = _judged(spark, d)
    return S.paired(maj, vav).select("fixed", "broken", F.round(S.mcnemar_p(F.col("fixed"), F.col("broken")), 6).alias("p"))


def spearman(spark, d):
    """Rank correlation of retail price and size in each brand."""
    return S.spearman(load(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"])


def pearson(spark, d):
    """Correlation of balance and key in each nation."""
    return S.pearson(load(spark, d, "customer"), "c_acctbal", "c_custkey", ["c_nationkey"])


def maj_at_k(spark, d):
    """maj@k, pass@k and mean accuracy for prefixes of the samples."""
    return S.maj_pass_at_k(_samples(spark, d), KS)


def prefix_grid(spark, d):
    """Accuracy by prefix and model, and over all models."""
    p = X.event_pool(load(spark, d, "events")).withColumn("correct", F.coalesce(F.col("res_cell") == F.col("qid") % 5, F.lit(False)))
    s = _first(p, ["qid", "model"], ["correct"])
    k = F.explode(F.array(*map(F.lit, KS))).alias("k")
    return s.select("model", "correct", "rn", k).where("rn <= k").rollup("k", "model").agg(F.count(F.lit(1)).alias("n"), S.rate(F.col("correct"), 6).alias("acc")).where("k is not null")


def _points(spark, d):
    v = S.prefix_votes(_samples(spark, d), KS).groupBy("qid", "k").agg(F.max_by("correct", F.struct(F.col("votes"), -F.col("first"))).alias("correct"))
    return v.select((F.col("qid") % 3).alias("bucket"), F.col("k").alias("n"), "correct", "qid")


def budget_curves(spark, d):
    """Accuracy at each budget and its gain, by bucket of questions."""
    return S.budget_curve(_points(spark, d))


def budget_saturation(spark, d):
    """Least budget within 0.01 of the last accuracy, by bucket."""
    return S.saturation(_points(spark, d), 0.01)


def question_saturation(spark, d):
    """Least budget at which a question has its final judgement."""
    p = _points(spark, d)
    last = p.groupBy("qid").agg(F.max_by("correct", "n").alias("last"))
    return p.join(last, "qid").where("correct = last").groupBy("qid").agg(F.min("n").alias("n_sat"))


def strategy_search(spark, d):
    """Cheapest choice of a budget for each bucket that reaches the best total of right questions less one percent."""
    each = _points(spark, d).groupBy("bucket", "n").agg(F.sum(F.col("correct").cast("bigint")).alias("right"), F.sum("n").alias("cost"))
    # Four budgets a bucket: one row of three short arrays, expanded to 64 rows whatever the data.
    lists = each.agg(*[F.collect_list(F.when(F.col("bucket") == b, F.struct("n", "right", "cost"))).alias(f"b{b}") for b in range(3)])
    for b in range(3):
        lists = lists.withColumn(f"x{b}", F.explode(f"b{b}"))
    total = lambda c: F.col(f"x0.{c}") + F.col(f"x1.{c}") + F.col(f"x2.{c}")
    grid = lists.select(*[F.col(f"x{b}.n").alias(f"n{b}") for b in range(3)], total("right").alias("right"), total("cost").alias("cost"))
    best = grid.agg(F.max("right").alias("best"))
    fit = grid.join(F.broadcast(best), F.col("right") >= F.col("best") * 0.99)
    key = F.struct("cost", F.negative("right"), "n0", "n1", "n2")
    return fit.agg(F.min_by(F.struct("n0", "n1", "n2", "right", "cost"), key).alias("w")).select("w.*")


def feature_correlations(spark, d):
    """Rank correlation of each feature of a part with its price, by unpivoting the features."""
    p = load(spark, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name_len"), F.length("p_type").cast("double").alias("type_len"))
    long = p.unpivot(["p_retailprice"], ["size", "name_len", "type_len"], "feature", "value")
    return S.spearman(long, "value", "p_retailprice", ["feature"])


def self_bleu(spark, d):
    """How alike the sampled texts of each question are."""
    e = X.dedupe(X.event_pool(load(spark, d, "events"))).select("qid", F.col("min_idx").alias("id"), F.col("key").alias("text"))
    return S.self_bleu(e)


def vote_strata(spark, d):
    """Questions and accuracy of the vote by votes of its winner: 0 to 5, then 6 and more."""
    e = X.entries_of(spark, d)
    w = P.arm_vav(P.build_groups(e))
    j = X.judged(w, e).join(w.select("qid", "size"), "qid")
    band = F.when(F.col("size") >= 6, "6+").otherwise(F.col("size").cast("string"))
    return j.groupBy(band.alias("votes")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"))


def size_buckets(spark, d):
    """Groups of the pool by size bucket and number of models."""
    g = P.build_groups(X.entries_of(spark, d))
    b = F.when(F.col("size") == 1, "1").when(F.col("size") <= 4, "2-4").when(F.col("size") <= 9, "5-9").otherwise("10+")
    return g.groupBy(b.alias("bucket"), "n_models").agg(F.count(F.lit(1)).alias("n"))


def gated_analysis(spark, d):
    """How the close-vote gate works: triggered, changed, improved, regressed."""
    e = X.entries_of(spark, d)
    g = P.build_groups(e)
    base, arm = P.arm_vav(g), P.ARMS["tiebreak"](g)
    close = P.gated(P.rankable(g)).select("qid", "close")
    a = X.judged(base, e).select("qid", F.col("rep").alias("ra"), F.col("correct").alias("ca"))
    b = X.judged(arm, e).select("qid", F.col("rep").alias("rb"), F.col("correct").alias("cb"))
    j = a.join(b, "qid").join(close, "qid")
    n = lambda c: F.sum(c.cast("bigint"))
    return j.agg(n(F.col("close")).alias("triggered"), n(F.col("ra") != F.col("rb")).alias("changed"), n(~F.col("ca") & F.col("cb")).alias("improved"), n(F.col("ca") & ~F.col("cb")).alias("regressed"))


def rank_metrics(spark, d):
    """Ranking quality of the scores against the gold result."""
    e = X.entries_of(spark, d).where("status <> 'err'")
    return S.ranking_metrics(e.select("qid", "key", "score", (F.coalesce(F.col("res_cell") % 7 == F.col("qid") % 5, F.lit(False)) & (F.col("status") == "ok")).cast("int").alias("label")))


def stage_agreement(spark, d):
    """Recall of the final winner among the k best of the first stage, for questions with more than k groups."""
    g = P.rankable(P.build_groups(X.entries_of(spark, d)))
    r = g.withColumn("ra", F.row_number().over(W.partitionBy("qid").orderBy(F.round(F.col("size") * F.col("mean_score"), 6).desc(), F.desc("sig")))).withColumn("rb", F.row_number().over(W.partitionBy("qid").orderBy(F.round(F.col("size") * F.col("score"), 6).desc(), F.desc("sig"))))
    top = r.where("rb = 1").join(g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_groups")), "qid")
    k = F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("k")
    return top.select("ra", "n_groups", k).where("n_groups > k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ra") <= F.col("k")).cast("double")), 6).alias("recall"))


def failure_diagnosis(spark, d):
    """Failures by class with their share, most first, three of them."""
    e = load(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "syntax").when(F.col("event_type") == "signup", "no_rows").when(F.col("value") < 25, "empty_sql").when(F.col("value") > 480, "timeout")
    c = e.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "kind").limit(3)


def winner_sources(spark, d):
    """Where winners come from in each pool, one column a source."""
    out = None
    for name, model in (("m1", "m1"), ("m2", "m2"), ("both", None)):
        e = X.entries_of(spark, d, model)
        f = P.with_fallback(X.event_pool(load(spark, d, "events")), P.arm_vav(P.build_groups(e)), P.majority(e)).select(F.lit(name).alias("pool"), "source")
        out = f if out is None else out.unionByName(f)
    return out.groupBy("pool").pivot("source", ["group", "fallback_maj", "no_pool"]).count().na.fill(0)


def label_stats(spark, d):
    """Positive share and all-right, all-wrong and mixed questions by model."""
    e = X.entries_of(spark, d).where("status <> 'err'").withColumn("label", F.coalesce(F.col("res_cell") % 7 == F.col("qid") % 5, F.lit(False)).cast("int")).select("qid", "label", F.explode("models").alias("model"))
    q = e.groupBy("model", "qid").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return q.groupBy("model").agg(
        F.sum("n").alias("n"), F.round(F.sum("pos") / F.sum("n"), 6).alias("pos_ratio"), F.sum((F.col("pos") == F.col("n")).cast("bigint")).alias("all_right"),
        F.sum((F.col("pos") == 0).cast("bigint")).alias("all_wrong"), F.sum(((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).cast("bigint")).alias("mixed"),
    )


def index_p90(spark, d):
    """The 90th percentile by place of the order totals of each priority."""
    return S.index_percentile(load(spark, d, "orders"), "o_totalprice", 0.9, ["o_orderpriority"])


def index_median(spark, d):
    """The median by place of document lengths of each source."""
    return S.index_percentile(load(spark, d, "documents").where("source is not null"), "n_chars", 0.5, ["source"])


def tie_ranks(spark, d):
    """Average ranks of tied part sizes in each brand."""
    return S.tie_ranks(load(spark, d, "part"), "p_size", ["p_brand"], "r")


def token_cost(spark, d):
    """Cost of calls by source with cheaper cached ones (every fourth)."""
    r = load(spark, d, "responses").select("response_id", "source", F.length("raw_response").alias("n")).dropDuplicates(["response_id"])
    t = F.greatest(F.lit(1), F.floor(F.coalesce("n", F.lit(0)) / 4))
    cost = t * F.when(F.col("response_id") % 4 == 0, 0.1).otherwise(1.0)
    return r.groupBy("source").agg(F.sum(t).alias("tokens"), F.round(F.sum(cost), 2).alias("cost"))


def metrics_coalesced(spark, d):
    """Metric of each response with fallbacks: seconds, else the length of the text, else 0."""
    r = load(spark, d, "responses").select("response_id", "generation_seconds", F.length("raw_response").alias("n")).dropDuplicates(["response_id"])
    return r.select("response_id", F.coalesce(F.round("generation_seconds", 3), F.col("n").cast("double"), F.lit(0.0)).alias("metric"))


QUERIES = {f.__name__: f for f in (run_summary, fixed_broken, mcnemar_counts, spearman, pearson, maj_at_k, prefix_grid, budget_curves, budget_saturation, question_saturation, strategy_search, feature_correlations, self_bleu, vote_strata, size_buckets, gated_analysis, rank_metrics, stage_agreement, failure_diagnosis, winner_sources, label_stats, index_p90, index_median, tie_ranks, token_cost, metrics_coalesced)}

J = f"jv AS (SELECT qid, rep, COALESCE(sig = {GOLD}, FALSE) AS correct, size FROM vav), jm AS (SELECT m.qid, COALESCE(array_to_string(s.vector, '|') = {GOLD.replace('qid', 'm.qid')}, FALSE) AS correct FROM maj m JOIN scored s ON s.qid = m.qid AND s.key = m.rep)"
PAIRED = f"WITH {POOL}, {VAV}, {MAJ}, {J}, pr AS (SELECT m.correct AS a, v.correct AS b FROM jm m JOIN jv v USING (qid)), c AS (SELECT CAST(SUM(CASE WHEN NOT a AND b THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(SUM(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS broken, CAST(SUM(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS same_right, CAST(SUM(CASE WHEN NOT a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS same_wrong FROM pr)"
KVOTES = f"{SAMPLES}, kv AS (SELECT qid, k, res, COUNT(*) AS votes, MIN(rn) AS f, bool_or(correct) AS correct FROM samples, (SELECT unnest([4, 8, 16, 32]) AS k) ks WHERE rn <= k GROUP BY 1, 2, 3), kq AS (SELECT qid, k, arg_max(correct, votes * 1000000 - f) AS maj, bool_or(correct) AS hit, MAX(votes) AS top, SUM(votes) AS n, SUM(CASE WHEN correct THEN votes ELSE 0 END) AS rgt, COUNT(*) AS groups FROM kv GROUP BY 1, 2), pts AS (SELECT qid % 3 AS bucket, k AS n, maj AS correct, qid FROM kq)"
SPEAR = """WITH x AS ({rows}), r AS (SELECT b, RANK() OVER (PARTITION BY b ORDER BY x) + (COUNT(*) OVER (PARTITION BY b, x) - 1) / 2.0::DOUBLE AS rx, RANK() OVER (PARTITION BY b ORDER BY y) + (COUNT(*) OVER (PARTITION BY b, y) - 1) / 2.0::DOUBLE AS ry FROM x)
SELECT b AS {by}, ROUND(CASE WHEN COUNT(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0.0 END, 6) AS rho FROM r GROUP BY b"""
PCT = "SELECT {by}, MIN(v) AS p FROM (SELECT {by}, {v} AS v, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {v}) AS rn, COUNT(*) OVER (PARTITION BY {by}) AS t FROM {t} WHERE {v} IS NOT NULL AND {by} IS NOT NULL) q WHERE rn = LEAST(FLOOR(t * {s}), t - 1) + 1 GROUP BY {by}"
ONCE = "(SELECT DISTINCT ON (response_id) * FROM responses)"

SQL = {
    "run_summary": f"SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN parse_success THEN 1 ELSE 0 END) AS BIGINT) AS n_parsed, ROUND(AVG(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS parse_rate, ROUND(AVG(generation_seconds), 4) AS mean_seconds FROM {ONCE}",
    "fixed_broken": f"{PAIRED} SELECT *, fixed - broken AS net FROM c",
    "mcnemar_counts": f"{PAIRED}, k AS (SELECT fixed, broken, fixed + broken AS n, LEAST(fixed, broken) AS k FROM c) SELECT fixed, broken, ROUND(CASE WHEN n = 0 THEN 1.0 ELSE LEAST(1.0, 2 * list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) FOR i IN range(0, k + 1)])) END, 6) AS p FROM k",
    "gated_analysis": f"WITH {POOL}, {TOPS}, tie AS ({ARM_SQL['tiebreak'].split(TOPS, 1)[1]}), {VAV}, j AS (SELECT v.rep AS ra, t.rep AS rb, v.sig = {GOLD.replace('qid', 'v.qid')} AS ca, t.sig = {GOLD.replace('qid', 'v.qid')} AS cb, {CLOSE} AS close FROM vav v JOIN tie t USING (qid) JOIN tops USING (qid)) SELECT CAST(SUM(close::INT) AS BIGINT) AS triggered, CAST(SUM((ra <> rb)::INT) AS BIGINT) AS changed, CAST(SUM((NOT ca AND cb)::INT) AS BIGINT) AS improved, CAST(SUM((ca AND NOT cb)::INT) AS BIGINT) AS regressed FROM j",
    "self_bleu": f"""WITH {POOL}, t AS (SELECT qid, min_idx AS id, string_split(key, ' ') AS w FROM entries), g AS (SELECT qid, id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) k),
      own AS (SELECT qid, n, id, g, COUNT(*) AS c FROM g GROUP BY ALL), tot AS (SELECT qid, n, g, SUM(c) AS t FROM own GROUP BY ALL), hit AS (SELECT qid, n, id, SUM(LEAST(c, t - c)) AS h, SUM(c) AS a FROM own JOIN tot USING (qid, n, g) GROUP BY ALL),
      lp AS (SELECT t.qid, t.id, AVG(ln((COALESCE(h, 0) + 1) / CAST(COALESCE(a, 0) + 1 AS DOUBLE))) AS l FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) k LEFT JOIN hit ON hit.qid = t.qid AND hit.id = t.id AND hit.n = k.n GROUP BY ALL)
      SELECT qid, ROUND(CASE WHEN COUNT(*) > 1 THEN AVG(exp(l)) ELSE 0.0 END, 6) AS self_bleu FROM lp GROUP BY qid""",
    "spearman": SPEAR.format(rows="SELECT p_brand AS b, p_size AS x, p_retailprice AS y FROM part", by="p_brand"),
    "pearson": "SELECT c_nationkey, ROUND(CASE WHEN COUNT(*) >= 2 THEN corr(c_acctbal, c_custkey) END, 6) AS r FROM customer GROUP BY c_nationkey",
    "maj_at_k": f"WITH {KVOTES} SELECT CAST(k AS INTEGER) AS k, ROUND(AVG(maj::INT::DOUBLE), 4) AS maj_at_k, ROUND(AVG(hit::INT::DOUBLE), 4) AS pass_at_k, ROUND(AVG(CAST(rgt AS DOUBLE) / n), 4) AS mean_at_k, ROUND(AVG((top * 2 > n)::INT::DOUBLE), 4) AS abs_majority, ROUND(AVG(CAST(groups AS DOUBLE)), 4) AS mean_groups FROM kq GROUP BY k",
    "prefix_grid": f"WITH {POOL}, s AS (SELECT model, ROW_NUMBER() OVER (PARTITION BY qid, model ORDER BY sample_idx) AS rn, COALESCE(res_cell = qid % 5, FALSE) AS correct FROM pool), x AS (SELECT k, model, correct FROM s, (SELECT unnest([4, 8, 16, 32]) AS k) t WHERE rn <= k) SELECT CAST(k AS INTEGER) AS k, model, COUNT(*) AS n, ROUND(AVG(correct::INT::DOUBLE), 6) AS acc FROM x GROUP BY GROUPING SETS ((k, model), (k))",
    "budget_curves": f"WITH {KVOTES}, a AS (SELECT bucket, n, ROUND(AVG(correct::INT::DOUBLE), 6) AS acc FROM pts GROUP BY 1, 2) SELECT bucket, CAST(n AS INTEGER) AS n, acc, ROUND(acc - LAG(acc) OVER (PARTITION BY bucket ORDER BY n), 6) AS gain FROM a",
    "budget_saturation": f"WITH {KVOTES}, a AS (SELECT bucket, n, ROUND(AVG(correct::INT::DOUBLE), 6) AS acc FROM pts GROUP BY 1, 2), l AS (SELECT bucket, arg_max(acc, n) AS last FROM a GROUP BY 1) SELECT a.bucket, CAST(MIN(n) AS INTEGER) AS n_sat FROM a JOIN l USING (bucket) WHERE acc >= last - 0.01 GROUP BY 1",
    "question_saturation": f"WITH {KVOTES}, l AS (SELECT qid, arg_max(correct, n) AS last FROM pts GROUP BY 1) SELECT qid, CAST(MIN(n) AS INTEGER) AS n_sat FROM pts JOIN l USING (qid) WHERE correct = last GROUP BY 1",
    "strategy_search": f"WITH {KVOTES}, e AS (SELECT bucket, n, SUM(correct::INT) AS r, SUM(n) AS c FROM pts GROUP BY 1, 2), g AS (SELECT a.n AS n0, b.n AS n1, c.n AS n2, a.r + b.r + c.r AS rgt, a.c + b.c + c.c AS cost FROM e a, e b, e c WHERE a.bucket = 0 AND b.bucket = 1 AND c.bucket = 2) SELECT CAST(n0 AS INTEGER) AS n0, CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, CAST(rgt AS BIGINT) AS right, CAST(cost AS BIGINT) AS cost FROM g WHERE rgt >= (SELECT MAX(rgt) FROM g) * 0.99 ORDER BY g.cost, g.rgt DESC, g.n0, g.n1, g.n2 LIMIT 1",
    "feature_correlations": SPEAR.format(rows="SELECT 'size' AS b, p_size::DOUBLE AS x, p_retailprice AS y FROM part UNION ALL SELECT 'name_len', length(p_name), p_retailprice FROM part UNION ALL SELECT 'type_len', length(p_type), p_retailprice FROM part", by="feature"),
    "vote_strata": f"WITH {POOL}, {VAV}, {MAJ}, {J} SELECT CASE WHEN size >= 6 THEN '6+' ELSE CAST(size AS VARCHAR) END AS votes, COUNT(*) AS n, CAST(SUM(correct::INT) AS BIGINT) AS n_correct FROM jv GROUP BY 1",
    "size_buckets": f"WITH {POOL} SELECT CASE WHEN size = 1 THEN '1' WHEN size <= 4 THEN '2-4' WHEN size <= 9 THEN '5-9' ELSE '10+' END AS bucket, CAST(n_models AS INTEGER) AS n_models, COUNT(*) AS n FROM groups GROUP BY 1, 2",
    "rank_metrics": f"WITH {POOL}, e AS (SELECT qid, key, score, CASE WHEN status = 'ok' AND res_cell % 7 = qid % 5 THEN 1 ELSE 0 END AS label FROM scored WHERE status <> 'err'), t AS (SELECT qid, arg_max(label, {{'s': score, 'k': key}}) AS f, MAX(label) AS hi, MIN(label) AS lo, list_reverse_sort(list_distinct(list(score))) AS ss FROM e GROUP BY qid) SELECT COUNT(*) AS n, ROUND(AVG(f::DOUBLE), 4) AS acc, CAST(SUM(CASE WHEN hi = 1 AND lo = 0 THEN 1 ELSE 0 END) AS BIGINT) AS recoverable, ROUND(AVG(CASE WHEN hi = 1 AND lo = 0 THEN f::DOUBLE END), 4) AS rank_acc, ROUND(AVG(COALESCE(ss[1] - ss[2] < 0.1, FALSE)::INT::DOUBLE), 4) AS tie_frac FROM t",
    "stage_agreement": f"WITH {POOL}, r AS (SELECT qid, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(size * mean_score, 6) DESC, sig DESC) AS ra, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(size * score, 6) DESC, sig DESC) AS rb, COUNT(*) OVER (PARTITION BY qid) AS n_groups FROM rankable) SELECT CAST(k AS INTEGER) AS k, COUNT(*) AS n, ROUND(AVG((ra <= k)::INT::DOUBLE), 6) AS recall FROM r, (SELECT unnest([1, 2, 3]) AS k) ks WHERE rb = 1 AND n_groups > k GROUP BY 1",
    "failure_diagnosis": "SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'syntax' WHEN event_type = 'signup' THEN 'no_rows' WHEN value < 25 THEN 'empty_sql' WHEN value > 480 THEN 'timeout' END AS kind FROM events) t WHERE kind IS NOT NULL GROUP BY kind ORDER BY n DESC, kind LIMIT 3",
    "label_stats": f"WITH {POOL}, e AS (SELECT qid, CASE WHEN res_cell % 7 = qid % 5 THEN 1 ELSE 0 END AS label, unnest(models) AS model FROM scored WHERE status <> 'err'), q AS (SELECT model, qid, COUNT(*) AS n, SUM(label) AS pos FROM e GROUP BY 1, 2) SELECT model, CAST(SUM(n) AS BIGINT) AS n, ROUND(CAST(SUM(pos) AS DOUBLE) / SUM(n), 6) AS pos_ratio, CAST(SUM((pos = n)::INT) AS BIGINT) AS all_right, CAST(SUM((pos = 0)::INT) AS BIGINT) AS all_wrong, CAST(SUM((pos > 0 AND pos < n)::INT) AS BIGINT) AS mixed FROM q GROUP BY model",
    "index_p90": PCT.format(by="o_orderpriority", v="o_totalprice", s="0.9", t="orders"),
    "index_median": PCT.format(by="source", v="n_chars", s="0.5", t="documents"),
    "tie_ranks": "SELECT DISTINCT p_brand, p_size, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM part",
    "token_cost": f"WITH t AS (SELECT source, response_id, CAST(GREATEST(1, COALESCE(length(raw_response), 0) // 4) AS BIGINT) AS k FROM {ONCE}) SELECT source, CAST(SUM(k) AS BIGINT) AS tokens, ROUND(SUM(k * CASE WHEN response_id % 4 = 0 THEN 0.1::DOUBLE ELSE 1.0 END), 2) AS cost FROM t GROUP BY source",
    "metrics_coalesced": f"SELECT response_id, COALESCE(ROUND(generation_seconds, 3), CAST(length(raw_response) AS DOUBLE), 0.0) AS metric FROM {ONCE}",
    "winner_sources": "SELECT pool, COUNT(*) FILTER (WHERE source = 'group') AS \"group\", COUNT(*) FILTER (WHERE source = 'fallback_maj') AS fallback_maj, COUNT(*) FILTER (WHERE source = 'no_pool') AS no_pool FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS pool, source FROM (WITH {POOL.replace('FROM events)', f'FROM events WHERE {c})')}, {MAJ}, {VAV} SELECT CASE WHEN v.rep IS NOT NULL THEN 'group' WHEN m.rep IS NOT NULL THEN 'fallback_maj' ELSE 'no_pool' END AS source FROM (SELECT DISTINCT user_id AS qid FROM events) q LEFT JOIN vav v USING (qid) LEFT JOIN maj m USING (qid))"
        for n, c in (("m1", "event_id % 2 = 0"), ("m2", "event_id % 2 <> 0"), ("both", "TRUE"))
    )
    + ") t GROUP BY pool",
}
