"""Candidate pools: deduplication, grouping by execution result, and the choice of a winner.

A pool has rows (qid, sample_idx, model, sql_text); an entry is a distinct text of
a question with its vector of signatures, one an instance. Everything is keyed by
question and pre-aggregated before each shuffle: every rule is one mergeable
aggregate (max_by or a bounded heap) over the groups with the question's figures
beside them, so all rules together take one grouping and one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.internal import InternalFunction

from quorumframe.functions.textops import count_joins

GATE_SIZE, GATE_GAP = 2, 1
DOMINANCE = 0.05


def normalized(sql: Column) -> Column:
    """Text key of a query: lower case, blanks collapsed, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))


def heap(order: Column, k: int, least: bool = False) -> Column:
    """The k largest (or least) structs of a group: a mergeable bounded heap; null ones are left out.

    The one place where Spark's own collect_top_k, which has no public name, is called.
    """
    return InternalFunction.collect_top_k(order, k, least)


def dedupe(pool: DataFrame, *extra: Column) -> DataFrame:
    """One row for each question and query text: votes, first sample, its writing, models, and extra aggregates.

    Null texts and null questions take no part. Ties of the first sample go to
    the smaller text. The number of models is bounded, so the set is too.
    """
    rows = pool.where("sql_text is not null and qid is not null").withColumn("key", normalized(F.col("sql_text")))
    return rows.groupBy("qid", "key").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("sample_idx").alias("min_idx"),
        F.min_by("sql_text", F.struct("sample_idx", "sql_text")).alias("sql_text"),
        F.array_sort(F.collect_set("model")).alias("models"),
        *extra,
    )


def build_groups(entries: DataFrame, vector: str = "vector", empty: Column | None = None, zero: Column | None = None) -> DataFrame:
    """Groups of equal vectors: size in votes, members, models, representative and its score.

    entries: qid, key, votes, min_idx, models, score and the vector. A candidate
    that fails in any instance is in no group. empty and zero tell the groups
    without a cell and those of zeros alone (aggregates over the members, which
    share them); by default they are read from one-cell signatures.
    """
    good = entries.where(~F.array_contains(vector, "ERROR"))
    v = F.col(vector)
    empty = F.first(F.forall(v, lambda x: x == "E")) if empty is None else empty
    zero = F.first(F.exists(v, lambda x: x != "E") & F.forall(v, lambda x: (x == "I0") | (x == "E"))) if zero is None else zero
    g = grouped(good, "qid", F.col(vector).alias("vector"), empty=empty, zero=zero)
    return g.select(
        "qid", "vector", F.array_join("vector", "|").alias("sig"), "size", "n_keys", "models", F.size("models").alias("n_models"), "rep", "rep_idx", "score", "best_score", "mean_score",
        "is_empty", "is_zero",
    )


def grouped(good: DataFrame, *by: Column | str, empty: Column, zero: Column) -> DataFrame:
    """Entries without failures by what tells their results: the figures of each group."""
    return good.groupBy(*by).agg(
        F.sum("votes").alias("size"),
        F.count(F.lit(1)).alias("n_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))).alias("models"),
        F.min_by("key", F.struct("min_idx", "key")).alias("rep"),
        F.min("min_idx").alias("rep_idx"),
        F.min_by("score", F.struct("min_idx", "key")).alias("score"),
        F.max("score").alias("best_score"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        empty.alias("is_empty"),
        zero.alias("is_zero"),
    )


def fine() -> Column:
    """Neither empty nor all zero."""
    return ~(F.col("is_empty") | F.col("is_zero"))


def rankable(groups: DataFrame) -> DataFrame:
    """Groups that are fine, and all groups of a question without fine ones."""
    any_fine = groups.groupBy("qid").agg(F.max(fine()).alias("any_fine"))
    return groups.join(any_fine, "qid").where(fine() | ~F.col("any_fine")).drop("any_fine")


def pick(groups: DataFrame, *order: Column, columns: tuple[str, ...] = ("rep", "size", "sig")) -> DataFrame:
    """The group of the largest order key of each question; every key ends in the unique signature."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate([*order, F.col("sig")])])
    best = groups.groupBy("qid").agg(F.max_by(F.struct(*columns), key).alias("w"))
    return best.select("qid", *[f"w.{c}" for c in columns])


def close_vote(first: Column, second: Column) -> Column:
    """Whether the vote of the two largest groups is close: top1 < 2 or a lead of at most 1."""
    return F.coalesce((first["size"] < GATE_SIZE) | (second.isNotNull() & (first["size"] - second["size"] <= GATE_GAP)), F.lit(False))


def gated(groups: DataFrame) -> DataFrame:
    """The two largest groups of each question and whether the vote is close."""
    top = groups.groupBy("qid").agg(heap(F.struct("size", "sig", "rep", "score", "n_models"), 2).alias("top"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return top.select("qid", first.alias("first"), second.alias("second"), close_vote(first, second).alias("close"))


def enriched(groups: DataFrame, ranks: bool = True) -> DataFrame:
    """Groups with what the rules need of their question: in_ (may win), top_size, all_votes, first, second, close and (ranks) beaten.

    beaten: how many rankable groups have a mean score more than DOMINANCE
    lower. It is counted from the question's distinct means (at most a million,
    as they have six digits), not from pairs of groups.
    """
    pair = F.struct("size", "sig", "score", "n_models")
    q = groups.groupBy("qid").agg(
        F.max(fine()).alias("any_fine"), F.max("size").alias("top_size"), F.sum("size").alias("all_votes"),
        heap(F.when(fine(), pair), 2).alias("top_fine"), heap(pair, 2).alias("top_all"),
    )
    top = F.when(F.col("any_fine"), F.col("top_fine")).otherwise(F.col("top_all"))
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    q = q.select("qid", "any_fine", "top_size", "all_votes", first.alias("first"), second.alias("second"), close_vote(first, second).alias("close"))
    out = groups.join(q, "qid").withColumn("in_", fine() | ~F.col("any_fine"))
    if ranks:
        micros = F.round(F.col("mean_score") * 1e6).cast("bigint").alias("micros")
        counts = out.where("in_").groupBy("qid", micros).agg(F.count(F.lit(1)).alias("n"))
        below = W.partitionBy("qid").orderBy("micros").rangeBetween(W.unboundedPreceding, -int(DOMINANCE * 1e6) - 1)
        counts = counts.select("qid", "micros", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("beaten"))
        out = out.withColumn("micros", micros).join(counts, ["qid", "micros"], "left").drop("micros")
    return out


def s() -> Column:
    """Votes of a group."""
    return F.col("size")


def p() -> Column:
    """Score of a group's representative; a missing one is 0."""
    return F.coalesce(F.col("score"), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(x: Column) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    return F.log(c / (1 - c))


def best(*order: Column, among: Column | None = None) -> Column:
    """Aggregate: (rep, size, sig) of the largest order key; groups where `among` does not hold are left out."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate([*order, F.col("sig")])])
    return F.max_by(F.struct("rep", "size", "sig"), key if among is None else F.when(among, key))


def on_close(c: Column) -> Column:
    return F.when(F.col("close"), c)


def tempered(t: float) -> Column:
    """Clean groups before empty or zero ones, then size times the tempered score."""
    return best(fine(), F.round(s() * sigmoid(logit(p()) / t), 6), s())


def cascade(k: int, among: Column | None) -> Column:
    """The k best groups by size times mean score (a bounded heap), then the best of them by size times the representative's."""
    stage = F.struct(F.round(s() * F.col("mean_score"), 6).alias("a"), F.col("sig").alias("sig"), s().alias("size"), F.col("rep").alias("rep"), p().alias("score"))
    kept = F.transform(heap(stage if among is None else F.when(among, stage), k), lambda t: F.struct(F.round(t["size"] * t["score"], 6).alias("k0"), t["sig"].alias("sig"), t["size"].alias("size"), t["rep"].alias("rep")))
    w = F.array_max(kept)
    return F.when(w.isNotNull(), F.struct(w["rep"].alias("rep"), w["size"].alias("size"), w["sig"].alias("sig")))


def runner_up(among: Column | None) -> Column:
    """Where the vote is close, the second group wins if its score is strictly higher."""
    want = F.when(F.col("close") & F.coalesce(F.col("second.score") > F.col("first.score"), F.lit(False)), F.col("second.sig")).otherwise(F.col("first.sig"))
    return best((F.col("sig") == want).cast("int"), among=among)


def by_structure(among: Column | None) -> Column:
    """Where the vote is close, groups of several models first, then size, then fewer joins in the representative; else the largest group."""
    return best(on_close((F.col("n_models") > 1).cast("int")), s(), on_close(-count_joins(F.col("rep"))), among=among)


def conservative(among: Column | None) -> Column:
    """Where the vote is close, the group of most models, then size, but only if it has more models than the largest group, or as many and more votes."""
    better = F.col("close") & ((F.col("n_models") > F.col("first.n_models")) | (F.col("n_models") == F.col("first.n_models")) & (s() > F.col("first.size")))
    return best(better.cast("int"), F.when(better, F.col("n_models")), F.when(better, s()), (F.col("sig") == F.col("first.sig")).cast("int"), among=among)


# A rule is an aggregate over the groups of a question that may win (among); these need no figure of their question.
PLAIN: dict[str, Callable[[Column | None], Column]] = {
    "vav": lambda among: best(s(), among=among),
    "soft_cross_w1": lambda among: best(s() + F.col("n_models"), among=among),
    "soft_cross_w2": lambda among: best(s() + 2 * F.col("n_models"), among=among),
    "soft_cross_w3": lambda among: best(s() + 3 * F.col("n_models"), among=among),
    "soft_ladder": lambda among: best((F.col("n_models") > 1).cast("int"), s(), among=among),
    "grouphead": lambda among: best(F.round(s() * p(), 6), s(), among=among),
    "tier_temp_half": lambda among: tempered(0.5),
    "tier_temp_1": lambda among: tempered(1.0),
    "tier_temp_2": lambda among: tempered(2.0),
    "soft_mean": lambda among: best(F.round(s() * F.col("mean_score"), 6), among=among),
    "cascade_2": lambda among: cascade(2, among),
    "cascade_4": lambda among: cascade(4, among),
}
# These need enriched groups.
WITH_FIGURES: dict[str, Callable[[Column | None], Column]] = {
    "gated": by_structure,
    "hybrid": lambda among: best(F.round(s() / F.col("top_size") * p(), 6)),
    "tiebreak": runner_up,
    "r3": lambda among: best(F.col("beaten"), F.round(s() * F.col("mean_score"), 6), s(), among=among),
    "vote_rate": lambda among: best(F.round(s() * s() / F.col("all_votes"), 6), among=among),
    "p03": conservative,
}
RULES = PLAIN | WITH_FIGURES


def arm(name: str) -> Callable[[DataFrame], DataFrame]:
    """A rule as a function from groups to winners (qid, rep, size, sig).

    A plain rule is one aggregation: its winner among the fine groups, else
    among all of a question.
    """
    rule = RULES[name]
    if name in PLAIN:
        won = lambda g: g.groupBy("qid").agg(F.coalesce(rule(fine()), rule(None)).alias("w"))
    else:
        won = lambda g: enriched(g, ranks=name == "r3").groupBy("qid").agg(rule(F.col("in_")).alias("w"))
    return lambda g: won(g).where("w is not null").select("qid", "w.rep", "w.size", "w.sig")


ARMS: dict[str, Callable[[DataFrame], DataFrame]] = {name: arm(name) for name in RULES}
arm_vav = ARMS["vav"]


def all_winners(groups: DataFrame) -> DataFrame:
    """(arm, qid, rep, size, sig) of every rule, from one aggregation; groups are read more than once, so pass them written."""
    each = enriched(groups).groupBy("qid").agg(*[rule(F.col("in_")).alias(name) for name, rule in RULES.items()])
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("arm"), F.col(name).alias("w")) for name in RULES]))
    return each.select("qid", named.alias("x")).where("x.w is not null").select("x.arm", "qid", "x.w.rep", "x.w.size", "x.w.sig")


def majority(entries: DataFrame) -> DataFrame:
    """The query text with most votes, then the earliest sample, then the larger text."""
    key = F.struct(F.col("votes"), -F.col("min_idx"), "key")
    best = entries.groupBy("qid").agg(F.max_by(F.struct("key", "votes"), key).alias("w"))
    return best.select("qid", F.col("w.key").alias("rep"), F.col("w.votes").alias("size"))


def argmax_score(entries: DataFrame) -> DataFrame:
    """The candidate of the highest score, then the earliest, then the larger text."""
    best = entries.groupBy("qid").agg(F.max_by(F.struct("key", "score"), F.struct(F.col("score"), -F.col("min_idx"), "key")).alias("w"))
    return best.select("qid", F.col("w.key").alias("rep"), F.col("w.score").alias("score"))


def with_fallback(questions: DataFrame, winners: DataFrame, maj: DataFrame) -> DataFrame:
    """The arm's winner, else the majority text, else SELECT 1, with where it comes from."""
    w = winners.select("qid", F.col("rep").alias("w_rep"))
    m = maj.select("qid", F.col("rep").alias("m_rep"))
    j = questions.select("qid").distinct().join(w, "qid", "left").join(m, "qid", "left")
    source = F.when(F.col("w_rep").isNotNull(), "group").when(F.col("m_rep").isNotNull(), "fallback_maj").otherwise("no_pool")
    return j.select("qid", F.coalesce("w_rep", "m_rep", F.lit("SELECT 1")).alias("rep"), source.alias("source"))


def judged(winners: DataFrame, right: DataFrame) -> DataFrame:
    """Whether each winner (qid, rep) is right by the judged texts (qid, rep, correct); a missing winner or judgement is wrong."""
    return winners.join(right.select("qid", "rep", "correct"), ["qid", "rep"], "left").select("qid", "rep", F.coalesce("correct", F.lit(False)).alias("correct"))
