"""Reports and rules over the fixture pool that both engines follow, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.operators import curate as C
from quorumframe.operators import equality as E
from quorumframe.operators import pool as P
from quorumframe.session import load, written

from . import fixture as X
from .adjudication import ARM_SQL, GOLD, POOL, VAV
from .curation import LAB, _labelled
from .curation import SQL as CURATION
from .evaluation import KVOTES, _points
from .results import PAIRS, pairs
from .results import SQL as RESULTS


def _gold_sig() -> Column:
    return F.concat_ws("|", *[F.concat(F.lit("I"), ((F.col("qid") % 5 + F.col("qid") * k) % 7).cast("string")) for k in range(X.INSTANCES)])


def cross_model(spark, d):
    """Groups by size bucket and whether several models gave them, with how many are right, and over all sizes."""
    g = P.build_groups(X.entries_of(spark, d))
    b = F.when(F.col("size") == 1, "1").when(F.col("size") <= 4, "2-4").when(F.col("size") <= 9, "5-9").otherwise(">=10")
    rows = g.select(b.alias("bucket"), (F.col("n_models") >= 2).alias("dual"), (F.col("sig") == _gold_sig()).cast("bigint").alias("right"))
    out = rows.groupingSets([["bucket", "dual"], ["dual"]], "bucket", "dual").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("n_correct"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def cross_model_winners(spark, d):
    """Winners of each rule by whether several models gave their group, with how many are right."""
    g = written(P.build_groups(X.entries_of(spark, d)), "groups", spark)
    w = P.all_winners(g).join(g.select("qid", "sig", "n_models"), ["qid", "sig"])
    return w.groupBy("arm", (F.col("n_models") >= 2).alias("dual")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("sig") == _gold_sig()).cast("bigint")).alias("n_correct"))


def _allocations(spark, d) -> DataFrame:
    """Every choice of a budget for three buckets (64 rows whatever the data) with right answers and cost."""
    each = _points(spark, d).groupBy("bucket", "n").agg(F.sum(F.col("correct").cast("bigint")).alias("right"), F.sum("n").alias("cost"))
    lists = each.agg(*[F.collect_list(F.when(F.col("bucket") == b, F.struct("n", "right", "cost"))).alias(f"b{b}") for b in range(3)])
    for b in range(3):
        lists = lists.withColumn(f"x{b}", F.explode(f"b{b}"))
    total = lambda c: F.col(f"x0.{c}") + F.col(f"x1.{c}") + F.col(f"x2.{c}")
    return lists.select(*[F.col(f"x{b}.n").alias(f"n{b}") for b in range(3)], total("right").alias("right"), total("cost").alias("cost"))


def strategy_variants(spark, d):
    """Budgets by three strategies: cheapest within one percent of the full budget's right answers, the same with budgets that do not fall, and the full budget for the last bucket with the most right answers for the others."""
    g = _allocations(spark, d)
    full = g.where("n0 = 32 and n1 = 32 and n2 = 32").select(F.col("right").alias("full_right"), F.col("cost").alias("full_cost"))
    g = g.join(F.broadcast(full))
    cheap = F.struct("cost", F.negative("right"), "n0", "n1", "n2")
    most = F.struct(F.negative("right"), "cost", "n0", "n1", "n2")
    enough = F.col("right") >= F.col("full_right") * 0.99
    rules = (("save", enough, cheap), ("save_rising", enough & (F.col("n0") <= F.col("n1")) & (F.col("n1") <= F.col("n2")), cheap), ("boost_last", (F.col("n2") == 32) & (F.col("cost") <= F.col("full_cost")), most))
    out = None
    for name, fits, key in rules:
        w = g.where(fits).agg(F.min_by(F.struct("n0", "n1", "n2", "right", "cost"), key).alias("w")).select(F.lit(name).alias("strategy"), "w.*")
        out = w if out is None else out.unionByName(w)
    return out


def budget_medians(spark, d):
    """By bucket: median of the least budget with the final judgement, of all questions and of those right in the end, and the share that the budget does not change."""
    p = _points(spark, d)
    q = p.groupBy("qid", "bucket").agg(F.max_by("correct", "n").alias("last"), F.min_by("correct", "n").alias("first"))
    sat = p.join(q, ["qid", "bucket"]).where("correct = last").groupBy("qid", "bucket", "first", "last").agg(F.min("n").alias("sat"))
    return sat.groupBy("bucket").agg(F.median("sat").alias("median"), F.median(F.when(F.col("last"), F.col("sat"))).alias("median_right"), F.round(F.avg((F.col("first") == F.col("last")).cast("double")), 6).alias("unchanged"))


def vote_mixed(spark, d):
    """The vote with empty groups kept and all-zero groups dropped; where sizes tie, the winner of the first model alone; without one, the larger signature."""
    g = P.build_groups(X.entries_of(spark, d))
    fine = g.groupBy("qid").agg(F.max(~F.col("is_zero")).alias("any_fine"))
    g = g.join(fine, "qid").where(~F.col("is_zero") | ~F.col("any_fine"))
    top = g.groupBy("qid").agg(P.heap(F.struct("size", "sig", "rep"), 2).alias("t"))
    top = top.select("qid", F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b")).withColumn("tie", F.coalesce(F.col("a.size") == F.col("b.size"), F.lit(False)))
    own = P.arm_vav(P.build_groups(X.entries_of(spark, d, "m1"))).select("qid", F.struct("size", "sig", "rep").alias("own"))
    w = F.when(F.col("tie") & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("a"))
    return top.join(own, "qid", "left").select("qid", w.alias("w"), (F.col("tie") & F.col("own").isNotNull()).alias("from_first")).select("qid", "w.rep", "w.size", "from_first")


RATIOS = (0.1, 0.25, 0.5)


def centroid_votes(spark, d):
    """The vote after each question has dropped a share of its candidates of least mean similarity, against the vote before: fixed and broken by share."""
    e = X.entries_of(spark, d).where("status = 'ok'")
    cells = e.groupBy("qid", "res_cell").agg(F.count(F.lit(1)).alias("n"))
    b = cells.select("qid", F.col("res_cell").alias("other"), F.col("n").alias("n_other"))
    sim = cells.join(b, "qid").groupBy("qid", "res_cell").agg(F.sum(F.col("n_other") / (1 + F.abs(F.col("res_cell") - F.col("other")))).alias("total"), F.sum("n_other").alias("k"))
    scored = e.join(sim, ["qid", "res_cell"]).withColumn("mean_sim", F.when(F.col("k") > 1, F.round((F.col("total") - 1) / (F.col("k") - 1), 6)).otherwise(1.0))
    place = F.row_number().over(C.W.partitionBy("qid").orderBy("mean_sim", "min_idx"))
    scored = written(scored.withColumn("place", place), "scored", spark)
    base = X.judged(P.arm_vav(P.build_groups(scored)), scored).select("qid", F.col("correct").alias("a"))
    out = None
    for r in RATIOS:
        drop = F.when(F.col("k") > 1, F.greatest(F.lit(1), F.least(F.col("k") - 1, F.round(F.col("k") * r)))).otherwise(0)
        kept = scored.where(F.col("place") > drop)
        w = X.judged(P.arm_vav(P.build_groups(kept)), kept).select(F.lit(r).alias("ratio"), "qid", F.col("correct").alias("b"))
        out = w if out is None else out.unionByName(w)
    n = lambda c: F.sum(c.cast("bigint"))
    return out.join(base, "qid").groupBy("ratio").agg(F.count(F.lit(1)).alias("n"), n(~F.col("a") & F.col("b")).alias("fixed"), n(F.col("a") & ~F.col("b")).alias("broken"))


def ablation_matrix(spark, d):
    """Right winners of two rules over each subset of models; votes are not counted again by model."""
    e = written(X.entries_of(spark, d), "entries", spark)
    out = None
    for tags in (("m1",), ("m2",), ("m1", "m2")):
        g = P.build_groups(e.where(F.arrays_overlap("models", F.array(*map(F.lit, tags)))))
        for name in ("vav", "grouphead"):
            w = P.ARMS[name](g).select(F.lit("+".join(tags)).alias("subset"), F.lit(name).alias("arm"), "qid", "sig")
            out = w if out is None else out.unionByName(w)
    return out.groupBy("subset", "arm").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("sig") == _gold_sig()).cast("bigint")).alias("n_correct"))


def perspective_winners(spark, d):
    """How often each model's own winner is the winner over all models, and how sure the vote is."""
    own = None
    for m in ("m1", "m2"):
        w = P.arm_vav(P.build_groups(X.entries_of(spark, d, m))).select("qid", F.lit(m).alias("model"), F.col("sig").alias("own"))
        own = w if own is None else own.unionByName(w)
    both = P.arm_vav(P.build_groups(X.entries_of(spark, d))).select("qid", "sig", "size")
    n = X.event_pool(load(spark, d, "events")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    j = own.join(both, "qid").join(n, "qid")
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("own") == F.col("sig")).cast("bigint")).alias("agrees"), F.round(F.avg(F.col("size") / F.col("n")), 6).alias("confidence"))


def degenerate_texts(spark, d):
    """Whether a text signature has no value, or only zeros; some values end in a percent sign, some rows have two cells."""
    k = F.col("qid") % 4
    cell = F.when(F.col("qid") % 3 == 0, F.lit("I0%")).otherwise(F.concat(F.lit("I"), (F.col("qid") % 2).cast("string")))
    rows = F.when(k == 0, F.array().cast("array<array<string>>")).when(k == 1, F.array(F.array(cell))).when(k == 2, F.array(F.array(F.lit("I0"), F.lit("I0")))).otherwise(F.array(F.array(F.lit("F0.0")), F.array(F.lit("N"))))
    sig = F.when(F.col("qid") % 7 == 0, F.lit("ERROR: syntax")).otherwise(E.sig_trunc200(F.lit(True), rows, F.lit("")))
    body = F.when(sig == "SUCCESS_VALUES:", sig).when(sig.startswith("ERROR"), sig).otherwise(F.concat(F.lit("SUCCESS_VALUES:"), sig))
    return pairs(spark, d).select("qid", E.text_is_empty(body).alias("empty"), E.text_is_all_zero(body).alias("zero"))


def best_of_golds(spark, d):
    """The highest weighted similarity of a part's words to those of its type, its brand and an empty text."""
    p = load(spark, d, "part")
    toks = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return p.select("p_partkey", E.best_similarity(F.lit(1.0), toks("p_name"), F.array(toks("p_type"), toks("p_brand"), toks(F.concat_ws(" ", "p_name", "p_type")))).alias("best"))


def example_pick(spark, d):
    """One easy, one medium and one hard example, each of a database not yet used where there is one, the shortest, then by index; missing classes are filled from the rest.

    Each class offers its three best of each of its databases' shortest heads, a
    bounded number of rows, from which three are picked one after the other.
    """
    q = load(spark, d, "questions").where("difficulty in ('easy', 'medium', 'hard') and gold_sql is not null and question is not null and di >= 0").dropDuplicates(["di"])
    q = q.select("di", "db_id", "difficulty", F.length("question").alias("n"))
    # Three picks use at most two other databases, so three databases a class and three rows of each are enough.
    by_db = q.groupBy("difficulty", "db_id").agg(P.heap(F.struct("n", "di"), 3, True).alias("xs"))
    offers = by_db.groupBy("difficulty").agg(P.heap(F.struct(F.get("xs", F.lit(0)).alias("head"), F.col("db_id"), F.col("xs")), 3, True).alias("dbs")).collect()
    rows = [{"class": o.difficulty, "db_id": x.db_id, "n": r.n, "di": r.di} for o in offers for x in o.dbs for r in x.xs]
    rank = {"easy": 0, "medium": 1, "hard": 2}
    picked: list[dict] = []

    def take(pool: list[dict], near: int | None = None) -> None:
        free = [r for r in pool if r not in picked]
        if free:
            used = {r["db_id"] for r in picked}
            picked.append(min(free, key=lambda r: (r["db_id"] in used, abs(rank[r["class"]] - near) if near is not None else 0, r["n"], r["di"])))

    for c in rank:
        take([r for r in rows if r["class"] == c])
    while len(picked) < 3 and any(r not in picked for r in rows):
        take(rows, 1)
    return spark.createDataFrame([(k, r["di"], r["db_id"]) for k, r in enumerate(picked)], "place int, di int, db_id string")


def target_funnel(spark, d):
    """Questions by the first reason that drops them as training targets, with their number."""
    q = load(spark, d, "questions").dropDuplicates(["di"])
    solved = _labelled(spark, d).groupBy("di").agg(F.max("label").alias("m"))
    j = q.join(solved, "di", "left")
    why = F.when(F.col("gold_sql").isNull(), "no_gold").when(~F.coalesce(F.col("difficulty").isin("hard", "extra"), F.lit(False)) & (F.coalesce("m", F.lit(0)) == 1), "solved_and_easy").when(F.length("gold_sql") > 200, "too_long").when(F.col("db_id").rlike("_\\d+$"), "numbered_db").otherwise("kept")
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shard_merge(spark, d):
    """Two overlapping shards merged: the later one wins, rows in the order of their target rank, and how many keys both had."""
    c = load(spark, d, "candidates").dropDuplicates(["id"]).where("vote is not null").select("di", "id", "vote")
    best = lambda df, k: df.groupBy("di").agg(F.max_by("id", F.struct("vote", "id")).alias("id")).withColumn("shard", F.lit(k))
    a, b = best(c.where("id % 2 = 0"), 1), best(c.where("di % 3 = 0"), 2)
    merged = C.last_wins(a.unionByName(b), "di", "shard")
    both = a.select("di").join(b.select("di"), "di").agg(F.count(F.lit(1)).alias("overlap"))
    return merged.crossJoin(F.broadcast(both))


def winner_levels(spark, d):
    """Accuracy of the vote by difficulty (by the question's key) and over all, with rows for each source of the winner."""
    e = X.entries_of(spark, d)
    f = P.with_fallback(X.event_pool(load(spark, d, "events")), P.arm_vav(P.build_groups(e)), P.majority(e))
    j = X.judged(f.select("qid", "rep"), e).join(f.select("qid", "source"), "qid")
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard", "extra"))), (F.col("qid") % 4 + 1).cast("int"))
    out = j.withColumn("level", level).groupingSets([["level", "source"], ["source"]], "level", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"))
    return out.withColumn("level", F.coalesce("level", F.lit("all")))


def changed_questions(spark, d):
    """Each question that a rule fixes or breaks against the vote, by rule."""
    g = written(P.build_groups(X.entries_of(spark, d)), "groups", spark)
    w = P.all_winners(g).select("arm", "qid", (F.col("sig") == _gold_sig()).alias("right"))
    base = w.where("arm = 'vav'").select("qid", F.col("right").alias("base"))
    j = w.where("arm <> 'vav'").join(base, "qid").where("right <> base")
    return j.select("arm", "qid", F.when(F.col("right"), "fixed").otherwise("broken").alias("change"))


def diff_sample(spark, d):
    """The five smallest rows that one of two results has more often than the other, for each side."""
    from .results import diff_rows

    kept = diff_rows(spark, d).groupBy("side").agg(P.heap(F.struct("a", "b", "n"), 5, True).alias("xs"))
    return kept.select("side", F.explode("xs").alias("x")).select("side", "x.a", "x.b", "x.n")


def label_histogram(spark, d):
    """Questions by how many of their candidates are right, up to five and more, with difficulty."""
    q = load(spark, d, "questions").select("di", F.coalesce("difficulty", F.lit("none")).alias("difficulty")).dropDuplicates(["di"])
    n = _labelled(spark, d).groupBy("di").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("right") >= 5, "5+").otherwise(F.col("right").cast("string"))
    return n.join(q, "di").groupBy("difficulty", band.alias("n_right")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("candidates"))


def feature_medians(spark, d):
    """Medians of features by band of size."""
    p = load(spark, d, "part")
    band = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large")
    return p.groupBy(band.alias("band")).agg(F.median("p_retailprice").alias("price"), F.median(F.length("p_name")).alias("name_length"), F.median(F.length("p_type")).alias("type_length"))


def recall_by_label(spark, d):
    """Retrieval quality by label of the query."""
    from .curation import recall_mrr

    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    return recall_mrr(spark, d).join(e, "qid").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_3"), 5).alias("recall_3"), F.round(F.avg("recall_8"), 5).alias("recall_8"), F.round(F.avg("mrr"), 5).alias("mrr"))


_F = (diff_sample, label_histogram, feature_medians, recall_by_label, cross_model, cross_model_winners, strategy_variants, budget_medians, vote_mixed, centroid_votes, ablation_matrix, perspective_winners, degenerate_texts, best_of_golds, example_pick, target_funnel, shard_merge, winner_levels, changed_questions)
QUERIES = {f.__name__: f for f in _F}

BUCKET = "CASE WHEN size = 1 THEN '1' WHEN size <= 4 THEN '2-4' WHEN size <= 9 THEN '5-9' ELSE '>=10' END"
ALL_ARMS = " UNION ALL ".join(f"SELECT '{k}' AS arm, qid, sig FROM ({v})" for k, v in ARM_SQL.items())
RIGHT = f"CAST(SUM((sig = {GOLD})::INT) AS BIGINT) AS n_correct"
GRID = "e AS (SELECT bucket, n, SUM(correct::INT) AS r, SUM(n) AS c FROM pts GROUP BY 1, 2), g AS (SELECT CAST(a.n AS INTEGER) AS n0, CAST(b.n AS INTEGER) AS n1, CAST(c.n AS INTEGER) AS n2, CAST(a.r + b.r + c.r AS BIGINT) AS rgt, CAST(a.c + b.c + c.c AS BIGINT) AS cost FROM e a, e b, e c WHERE a.bucket = 0 AND b.bucket = 1 AND c.bucket = 2), full_ AS (SELECT rgt AS fr, cost AS fc FROM g WHERE n0 = 32 AND n1 = 32 AND n2 = 32)"


def _pick(name: str, fits: str, order: str) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS strategy, n0, n1, n2, rgt AS \"right\", cost FROM g, full_ WHERE {fits} ORDER BY {order} LIMIT 1) s_{name}"


def _sub(where: str) -> str:
    return POOL.replace("FROM events)", f"FROM events WHERE {where})")


SIM = "sim AS (SELECT a.qid, a.key, a.min_idx, COUNT(*) AS k, CASE WHEN COUNT(*) > 1 THEN ROUND((SUM(1.0::DOUBLE / (1 + ABS(a.res_cell - b.res_cell))) - 1) / (COUNT(*) - 1), 6) ELSE 1.0 END AS ms FROM scored a JOIN scored b ON a.qid = b.qid AND b.status = 'ok' WHERE a.status = 'ok' GROUP BY 1, 2, 3), pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ms, min_idx) AS place FROM sim)"


def _kept(r: float) -> str:
    """Judged vote over what is left at a share (0: all)."""
    drop = f"CASE WHEN k > 1 THEN GREATEST(1, LEAST(k - 1, ROUND(k * {r}))) ELSE 0 END" if r else "0"
    return f"""SELECT qid, sig = {GOLD} AS ok FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY size DESC, sig DESC) AS rn FROM (SELECT *, MAX(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY qid) AS fine FROM (SELECT s.qid, array_to_string(s.vector, '|') AS sig, SUM(s.votes) AS size, array_to_string(s.vector, '|') = 'I0|I0|I0' AS zero FROM scored s JOIN pl ON pl.qid = s.qid AND pl.key = s.key WHERE pl.place > {drop} GROUP BY s.qid, s.vector) a) b WHERE fine = 0 OR NOT zero) c WHERE rn = 1"""


Q1 = "SELECT di, db_id, LENGTH(question) AS n FROM (SELECT DISTINCT ON (di) * FROM questions) q WHERE gold_sql IS NOT NULL AND question IS NOT NULL AND di >= 0 AND difficulty = '{c}'"
SQL = {
    "diff_sample": f"SELECT side, a, b, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side ORDER BY a, b, n) AS rn FROM ({RESULTS['diff_rows']}) x) y WHERE rn <= 5",
    "label_histogram": f"WITH {LAB}, n AS (SELECT di, SUM(label) AS r, COUNT(*) AS n FROM lab GROUP BY di) SELECT COALESCE(difficulty, 'none') AS difficulty, CASE WHEN r >= 5 THEN '5+' ELSE CAST(CAST(r AS INTEGER) AS VARCHAR) END AS n_right, COUNT(*) AS n, CAST(SUM(n) AS BIGINT) AS candidates FROM n JOIN (SELECT DISTINCT ON (di) di, difficulty FROM questions) q USING (di) GROUP BY 1, 2",
    "feature_medians": "SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS band, CAST(MEDIAN(p_retailprice) AS DOUBLE) AS price, CAST(MEDIAN(length(p_name)) AS DOUBLE) AS name_length, CAST(MEDIAN(length(p_type)) AS DOUBLE) AS type_length FROM part GROUP BY 1",
    "recall_by_label": f"SELECT label, COUNT(*) AS n, ROUND(AVG(recall_3), 5) AS recall_3, ROUND(AVG(recall_8), 5) AS recall_8, ROUND(AVG(mrr), 5) AS mrr FROM ({CURATION['recall_mrr']}) r JOIN embeddings e ON e.vec_id = r.qid GROUP BY label",
    "cross_model": f"WITH {POOL}, b AS (SELECT {BUCKET} AS bucket, n_models >= 2 AS dual, sig, qid FROM groups) SELECT COALESCE(bucket, 'all') AS bucket, dual, COUNT(*) AS n, {RIGHT} FROM b GROUP BY GROUPING SETS ((bucket, dual), (dual))",
    "cross_model_winners": f"WITH {POOL}, w AS ({ALL_ARMS}) SELECT arm, n_models >= 2 AS dual, COUNT(*) AS n, CAST(SUM((w.sig = {GOLD.replace('qid', 'w.qid')})::INT) AS BIGINT) AS n_correct FROM w JOIN groups g ON g.qid = w.qid AND g.sig = w.sig GROUP BY 1, 2",
    "strategy_variants": f"WITH {KVOTES}, {GRID} " + " UNION ALL ".join([_pick("save", "rgt >= fr * 0.99", "cost, rgt DESC, n0, n1, n2"), _pick("save_rising", "rgt >= fr * 0.99 AND n0 <= n1 AND n1 <= n2", "cost, rgt DESC, n0, n1, n2"), _pick("boost_last", "n2 = 32 AND cost <= fc", "rgt DESC, cost, n0, n1, n2")]),
    "budget_medians": f"WITH {KVOTES}, l AS (SELECT qid, bucket, arg_max(correct, n) AS last, arg_min(correct, n) AS f FROM pts GROUP BY 1, 2), s AS (SELECT l.*, (SELECT MIN(n) FROM pts p WHERE p.qid = l.qid AND p.correct = l.last) AS sat FROM l) SELECT bucket, CAST(MEDIAN(sat) AS DOUBLE) AS median, CAST(MEDIAN(sat) FILTER (WHERE last) AS DOUBLE) AS median_right, ROUND(AVG((f = last)::INT::DOUBLE), 6) AS unchanged FROM s GROUP BY bucket",
    "vote_mixed": f"WITH {POOL}, z AS (SELECT *, MAX((NOT is_zero)::INT) OVER (PARTITION BY qid) AS fine FROM groups), r AS (SELECT *, ROW_NUMBER() OVER w AS rn, LEAD(size) OVER w AS nxt FROM z WHERE fine = 0 OR NOT is_zero WINDOW w AS (PARTITION BY qid ORDER BY size DESC, sig DESC)), own AS (SELECT * FROM (WITH {_sub('event_id % 2 = 0')}, {VAV} SELECT qid, rep, size FROM vav)) SELECT r.qid, CASE WHEN r.size = nxt AND own.qid IS NOT NULL THEN own.rep ELSE r.rep END AS rep, CASE WHEN r.size = nxt AND own.qid IS NOT NULL THEN own.size ELSE r.size END AS size, COALESCE(r.size = nxt, FALSE) AND own.qid IS NOT NULL AS from_first FROM r LEFT JOIN own USING (qid) WHERE rn = 1",
    "centroid_votes": f"WITH {POOL}, {SIM}, base AS ({_kept(0)}) SELECT ratio, COUNT(*) AS n, CAST(SUM((NOT a AND b)::INT) AS BIGINT) AS fixed, CAST(SUM((a AND NOT b)::INT) AS BIGINT) AS broken FROM (" + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS ratio, base.ok AS a, w.ok AS b FROM base JOIN ({_kept(r)}) w USING (qid)" for r in RATIOS) + ") t GROUP BY ratio",
    "ablation_matrix": " UNION ALL ".join(
        f"SELECT '{n}' AS subset, '{arm}' AS arm, COUNT(*) AS n, {RIGHT} FROM ({ARM_SQL[arm].replace(chr(39) + 'err' + chr(39) + ' GROUP BY qid, vector', chr(39) + 'err' + chr(39) + ' AND ' + c + ' GROUP BY qid, vector')}) x"
        for arm in ("vav", "grouphead") for n, c in (("m1", "list_contains(models, 'm1')"), ("m2", "list_contains(models, 'm2')"), ("m1+m2", "TRUE"))
    ),
    "perspective_winners": "WITH o AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, qid, sig AS own FROM (WITH {_sub(c)}, {VAV} SELECT * FROM vav)" for m, c in (("m1", "event_id % 2 = 0"), ("m2", "event_id % 2 <> 0"))) + f"), b AS (SELECT * FROM (WITH {POOL}, {VAV} SELECT qid, sig, size FROM vav)), n AS (SELECT user_id AS qid, COUNT(*) AS n FROM events GROUP BY 1) SELECT model, COUNT(*) AS n, CAST(SUM((own = sig)::INT) AS BIGINT) AS agrees, ROUND(AVG(CAST(size AS DOUBLE) / n.n), 6) AS confidence FROM o JOIN b USING (qid) JOIN n USING (qid) GROUP BY model",
    "degenerate_texts": f"{PAIRS} SELECT qid, qid % 7 = 0 OR qid % 4 = 0 AS empty, qid % 7 <> 0 AND (qid % 4 = 3 OR qid % 4 = 1 AND (qid % 3 = 0 OR qid % 2 = 0)) AS zero FROM pairs",
    "best_of_golds": "WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, [list_distinct(string_split(lower(p_type), ' ')), list_distinct(string_split(lower(p_brand), ' ')), list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))] AS gs FROM part) SELECT p_partkey, ROUND(0.05 + 0.95 * 0.79 * pow(list_max([CAST(len(list_intersect(a, g)) AS DOUBLE) / len(list_distinct(list_concat(a, g))) FOR g IN gs]), 0.20), 6) AS best FROM t",
    "example_pick": f"WITH e AS ({Q1.format(c='easy')} ORDER BY n, di LIMIT 1), m AS (SELECT q.* FROM ({Q1.format(c='medium')}) q ORDER BY q.db_id IN (SELECT db_id FROM e), q.n, q.di LIMIT 1), h AS (SELECT q.* FROM ({Q1.format(c='hard')}) q ORDER BY q.db_id IN (SELECT db_id FROM e UNION ALL SELECT db_id FROM m), q.n, q.di LIMIT 1) SELECT CAST(0 AS INTEGER) AS place, di, db_id FROM e UNION ALL SELECT 1, di, db_id FROM m UNION ALL SELECT 2, di, db_id FROM h",
    "target_funnel": f"WITH {LAB}, s AS (SELECT di, MAX(label) AS m FROM lab GROUP BY di) SELECT CASE WHEN gold_sql IS NULL THEN 'no_gold' WHEN NOT COALESCE(difficulty IN ('hard', 'extra'), FALSE) AND COALESCE(m, 0) = 1 THEN 'solved_and_easy' WHEN length(gold_sql) > 200 THEN 'too_long' WHEN regexp_matches(db_id, '_\\d+$') THEN 'numbered_db' ELSE 'kept' END AS reason, COUNT(*) AS n FROM (SELECT DISTINCT ON (di) * FROM questions) q LEFT JOIN s USING (di) GROUP BY 1",
    "shard_merge": "WITH c AS (SELECT DISTINCT ON (id) di, id, vote FROM candidates WHERE vote IS NOT NULL), a AS (SELECT di, arg_max(id, {'v': vote, 'i': id}) AS id FROM c WHERE id % 2 = 0 GROUP BY di), b AS (SELECT di, arg_max(id, {'v': vote, 'i': id}) AS id FROM c WHERE di % 3 = 0 GROUP BY di) SELECT COALESCE(b.di, a.di) AS di, COALESCE(b.id, a.id) AS id, CAST(CASE WHEN b.di IS NULL THEN 1 ELSE 2 END AS INTEGER) AS shard, (SELECT COUNT(*) FROM a JOIN b USING (di)) AS overlap FROM a FULL JOIN b ON a.di = b.di",
    "winner_levels": f"WITH {POOL}, maj AS (SELECT qid, key AS rep, array_to_string(vector, '|') AS sig FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votes DESC, min_idx) AS rn FROM scored) t WHERE rn = 1), {VAV}, f AS (SELECT m.qid, COALESCE(v.sig, m.sig) AS sig, CASE WHEN v.qid IS NOT NULL THEN 'group' ELSE 'fallback_maj' END AS source FROM maj m LEFT JOIN vav v USING (qid)), l AS (SELECT *, ['easy', 'medium', 'hard', 'extra'][qid % 4 + 1] AS level FROM f) SELECT COALESCE(level, 'all') AS level, source, COUNT(*) AS n, {RIGHT} FROM l GROUP BY GROUPING SETS ((level, source), (source))",
    "changed_questions": f"WITH w AS (SELECT arm, qid, sig = {GOLD} AS ok FROM ({ALL_ARMS}) x) SELECT w.arm, w.qid, CASE WHEN w.ok THEN 'fixed' ELSE 'broken' END AS change FROM w JOIN w b ON b.qid = w.qid AND b.arm = 'vav' WHERE w.arm <> 'vav' AND w.ok <> b.ok",
}
