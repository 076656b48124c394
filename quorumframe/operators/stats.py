"""Evaluation statistics over winners, curves and scores, as mergeable aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rate(c: Column, digits: int = 4) -> Column:
    return F.round(F.avg(c.cast("double")), digits)


def run_summary(items: DataFrame) -> DataFrame:
    """Counts and rates of parsed items and mean seconds; an empty input gives one row of zeros."""
    ok = F.coalesce(F.col("parse_success"), F.lit(False))
    return items.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("n_parsed"),
        F.coalesce(rate(ok), F.lit(0.0)).alias("parse_rate"), F.coalesce(F.round(F.avg("generation_seconds"), 4), F.lit(0.0)).alias("mean_seconds"),
    )


def paired(base: DataFrame, other: DataFrame, key: str = "qid") -> DataFrame:
    """Fixed, broken, both right, both wrong and net of two judged runs (columns key, correct); nulls count as wrong."""
    j = base.select(key, F.coalesce("correct", F.lit(False)).alias("a")).join(other.select(key, F.coalesce("correct", F.lit(False)).alias("b")), key)
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    a, b = F.col("a"), F.col("b")
    return j.agg(n(~a & b).alias("fixed"), n(a & ~b).alias("broken"), n(a & b).alias("same_right"), n(~a & ~b).alias("same_wrong")).withColumn("net", F.col("fixed") - F.col("broken"))


def mcnemar(fixed: int, broken: int) -> float:
    """Exact two-sided McNemar test of two counts (on the driver)."""
    n = fixed + broken
    if n == 0:
        return 1.0
    k = min(fixed, broken)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def running(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values of each group with the rows that have them (_n) and all rows up to them (_upto).

    A group's values are cut at approximate quantiles into as many ranges as
    there are shuffle partitions; each range is summed on its own, and only the
    sums of the ranges are put in order, so no group meets in one task.
    """
    k = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / k for i in range(1, k)], 100 * k).alias("_q"))
    part = counts.join(cuts, by).withColumn("_p", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    up = W.partitionBy(*by).orderBy("_p")
    before = part.groupBy(*by, "_p").agg(F.sum("_n").alias("_m")).select(*by, "_p", (F.sum("_m").over(up) - F.col("_m")).alias("_before"))
    inside = W.partitionBy(*by, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return part.withColumn("_in", F.sum("_n").over(inside)).join(before, [*by, "_p"]).select(*by, value, "_n", (F.col("_in") + F.col("_before")).alias("_upto"))


def mcnemar_p(a: Column, b: Column) -> Column:
    """Exact two-sided test as an expression: twice the lower tail of a fair binomial, at most 1.

    The tail is one fold over its terms, each made from the one before it; sums
    are kept relative to the last term, so large counts do not underflow.
    """
    n, k = (a + b).cast("double"), F.least(a, b).cast("int")
    # From the largest term back: term(i - 1) = term(i) * i / (n - i + 1).
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    back = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), zero, lambda acc, i: F.when(k == 0, acc).otherwise(F.struct((acc["t"] * (k - i) / (n - k + i + 1)).alias("t"), (acc["s"] + acc["t"] * (k - i) / (n - k + i + 1)).alias("s"))))
    # log of C(n, k) / 2^n by one fold over k factors.
    log_c = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(k == 0, 0.0).otherwise(F.log((n - k + i) / i)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * back["s"] * F.exp(log_c - n * F.log(F.lit(2.0)))))


def tie_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average ranks of tied values, from the counts of distinct values of a group, not from its rows. Null values and groups have no rank."""
    rows = df.where(" and ".join(f"{c} is not null" for c in [*by, value]))
    return running(rows, value, by).select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null without variance on either side."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of x and y in each group with ties averaged; 0 under three rows or without variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = rows.join(tie_ranks(rows, x, by, "_rx"), [*by, x]).join(tie_ranks(rows, y, by, "_ry"), [*by, y])
    rho = F.when(F.count(F.lit(1)) >= 3, correlation("_rx", "_ry"))
    return r.groupBy(*by).agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of x and y in each group; null under two rows or without variance."""
    fine = F.count(F.lit(1)) >= 2
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.round(F.when(fine, correlation(x, y)), 6).alias("r"))


def prefix_votes(samples: DataFrame, ks: list[int]) -> DataFrame:
    """For each question and prefix length k of its samples: votes of each result among the first k.

    samples: qid, rn (place of the sample, from 1), res, correct. One row is
    expanded only to the lengths that hold it, and votes are pre-aggregated.
    """
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return samples.select("qid", "rn", "res", "correct", k).where("rn <= k").groupBy("qid", "k", "res").agg(F.count(F.lit(1)).alias("votes"), F.min("rn").alias("first"), F.max("correct").alias("correct"))


def maj_pass_at_k(samples: DataFrame, ks: list[int]) -> DataFrame:
    """maj@k, pass@k, mean accuracy@k, absolute majority and mean number of groups for each k."""
    v = prefix_votes(samples, ks)
    q = v.groupBy("qid", "k").agg(
        F.max_by("correct", F.struct(F.col("votes"), -F.col("first"))).alias("maj"), F.max("correct").alias("any"), F.max("votes").alias("top"),
        F.sum("votes").alias("n"), F.sum(F.col("votes") * F.col("correct").cast("int")).alias("right"), F.count(F.lit(1)).alias("groups"),
    )
    return q.groupBy("k").agg(
        rate(F.col("maj")).alias("maj_at_k"), rate(F.col("any")).alias("pass_at_k"), F.round(F.avg(F.col("right") / F.col("n")), 4).alias("mean_at_k"),
        rate(F.col("top") * 2 > F.col("n")).alias("abs_majority"), F.round(F.avg("groups"), 4).alias("mean_groups"),
    )


def budget_curve(points: DataFrame, key: str = "bucket") -> DataFrame:
    """Accuracy at each budget with the gain over the budget before (columns key, n, correct)."""
    acc = points.groupBy(key, "n").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc"))
    return acc.withColumn("gain", F.round(F.col("acc") - F.lag("acc").over(W.partitionBy(key).orderBy("n")), 6))


def saturation(points: DataFrame, slack: float = 0.0, key: str = "bucket") -> DataFrame:
    """The least budget whose accuracy is within slack of the last one."""
    acc = points.groupBy(key, "n").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc"))
    last = acc.groupBy(key).agg(F.max_by("acc", "n").alias("last"))
    return acc.join(last, key).where(F.col("acc") >= F.col("last") - slack).groupBy(key).agg(F.min("n").alias("n_sat"))


def index_percentile(df: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """The value at place int(n * share) of the sorted values, from counts of distinct values (no list of the group)."""
    rows = df.where(" and ".join(f"{c} is not null" for c in [*by, value]))
    run = running(rows, value, by)
    total = run.groupBy(*by).agg(F.max("_upto").alias("_t"))
    return run.join(total, by).where(F.col("_upto") > F.least(F.floor(F.col("_t") * share), F.col("_t") - 1)).groupBy(*by).agg(F.min(value).alias("p"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def self_bleu(texts: DataFrame, max_n: int = 4) -> DataFrame:
    """How alike the texts of a question are: clipped n-gram precision of each against all others, +1 smoothed, geometric mean over n.

    texts: qid, id, text. The count of an n-gram in the others is its total less
    the text's own, so no pairs of texts are formed. Questions of fewer than two
    texts score 0.
    """
    t = texts.where("text is not null").select("qid", "id", F.split(F.lower(F.trim("text")), r"\s+").alias("w"))
    sizes = t.groupBy("qid").agg(F.count(F.lit(1)).alias("m"))
    grams = None
    for n in range(1, max_n + 1):
        g = t.select("qid", "id", F.lit(n).alias("n"), F.explode(ngrams(F.col("w"), n)).alias("g"))
        grams = g if grams is None else grams.unionByName(g)
    own = grams.groupBy("qid", "n", "id", "g").agg(F.count(F.lit(1)).alias("c"))
    total = own.groupBy("qid", "n", "g").agg(F.sum("c").alias("t"))
    hit = own.join(total, ["qid", "n", "g"]).groupBy("qid", "n", "id").agg(F.sum(F.least("c", F.col("t") - F.col("c"))).alias("hit"), F.sum("c").alias("all"))
    each = t.select("qid", "id", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
    p = each.join(hit, ["qid", "id", "n"], "left").select("qid", "id", F.log((F.coalesce("hit", F.lit(0)) + 1) / (F.coalesce("all", F.lit(0)) + 1)).alias("lp"))
    score = p.groupBy("qid", "id").agg(F.exp(F.avg("lp")).alias("b")).groupBy("qid").agg(F.avg("b").alias("b"))
    return score.join(sizes, "qid").select("qid", F.round(F.when(F.col("m") > 1, F.col("b")).otherwise(0.0), 6).alias("self_bleu"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """Per-question ranking of scored candidates (qid, key, score, label): accuracy of the first, of those recoverable, near ties."""
    top = scored.groupBy("qid").agg(
        F.max_by("label", F.struct("score", "key")).alias("first"), F.max("label").alias("any"), F.min("label").alias("all"),
        F.max("score").alias("s1"), F.sort_array(F.collect_set("score"), False).alias("ss"),
    )
    gap = F.when(F.size("ss") > 1, F.col("ss")[0] - F.col("ss")[1])
    mixed = F.col("any").cast("boolean") & ~F.col("all").cast("boolean")
    return top.agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("first")).alias("acc"), F.sum(mixed.cast("bigint")).alias("recoverable"),
        F.round(F.avg(F.when(mixed, F.col("first").cast("double"))), 4).alias("rank_acc"), rate(F.coalesce(gap < 0.1, F.lit(False))).alias("tie_frac"),
    )
