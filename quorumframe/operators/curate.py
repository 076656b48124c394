"""Curation: labelled sets, guards, balanced samples, merges and overlays.

Random choices are made by the order of md5 of a seed and the row's key, so any
engine and any partitioning makes the same choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .pool import heap


def draw(seed: int | str, *keys: Column) -> Column:
    """A draw for a row: the md5 text of seed and keys (nulls as empty texts)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key as a whole (max_by over structs: one row a key and task is shuffled); ties by all columns."""
    cols = df.columns
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c not in (key, order)])).alias("_r"))
    return best.select("_r.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key."""
    cols = df.columns
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(order, *[c for c in cols if c not in (key, order)])).alias("_r"))
    return best.select("_r.*")


def lowest_draws(df: DataFrame, group: str, id_: str, k: int, seed: int | str) -> DataFrame:
    """At most k rows of each group, those of the lowest draw: a bounded heap for each group and task."""
    pair = F.struct(draw(seed, F.col(id_)).alias("d"), F.col(id_).alias(id_))
    kept = df.groupBy(group).agg(heap(pair, k, True).alias("h"))
    return kept.select(group, F.explode("h").alias("h")).select(group, F.col(f"h.{id_}").alias(id_))


def stratified_cap(df: DataFrame, group: str, id_: str, label: str, k: int, seed: int | str = 7) -> DataFrame:
    """All positives of each group and negatives drawn to k rows in all (group, id, label). A group of more than k positives keeps them all."""
    pos = df.where(F.col(label) == 1).select(group, id_, label)
    room = df.groupBy(group).agg((F.lit(k) - F.sum((F.col(label) == 1).cast("int"))).alias("_room"))
    neg = df.where(F.col(label) == 0)
    drawn = lowest_draws(neg, group, id_, k, seed)
    w = W.partitionBy(group).orderBy(draw(seed, F.col(id_)), id_)  # at most k rows a group
    fit = drawn.withColumn("_n", F.row_number().over(w)).join(room, group).where("_n <= _room")
    return pos.unionByName(fit.select(group, id_, F.lit(0).cast(dict(df.dtypes)[label]).alias(label)))


def upsample(df: DataFrame, label: str, times: int) -> DataFrame:
    """Positives `times` times, others once, with the number of the copy."""
    n = F.when(F.col(label) == 1, F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def downsample_with_floor(df: DataFrame, group: str, id_: str, label: str, share: float, seed: int | str = 7) -> DataFrame:
    """Positives, the lowest-drawn negative of each group, and further negatives whose draw falls under the share.

    The share is a bound on the draw read as a fraction, so no global sort is made.
    """
    frac = F.conv(F.substring(draw(seed, F.col(id_)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    floor = df.where(F.col(label) == 0).groupBy(group).agg(F.min_by(id_, F.struct(draw(seed, F.col(id_)), id_)).alias("_floor"))
    j = df.join(floor, group, "left")
    return j.where((F.col(label) == 1) | (F.col(id_) == F.col("_floor")) | (frac < share)).drop("_floor")


def question_split(df: DataFrame, key: str, valid_share: float, seed: int | str = 13) -> Column:
    """'valid' or 'train' by the draw of the key, so rows of one question stay together."""
    frac = F.conv(F.substring(draw(seed, F.col(key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.when(frac < valid_share, "valid").otherwise("train")


def funnel(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """The first reason that drops a row, else 'kept', as column reason. A null condition does not drop."""
    out = F.lit("kept")
    for name, cond in reversed(reasons):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return df.withColumn("reason", out)


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the rows of patch in place of those of the same key, and the rest of patch added. patch has one row a key."""
    return base.join(patch.select(key), key, "left_anti").unionByName(patch)


def leak_guard(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows of train whose key is not held out; null keys stay."""
    return train.join(held_out.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def insist_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if a key is on both sides."""
    found = a.join(b.select(key), key, "left_semi").limit(1).collect()
    if found:
        raise ValueError(f"{key} on both sides, such as {found[0][key]}")


def pending(questions: DataFrame, done: DataFrame, key: str, models: list[str], want: int) -> DataFrame:
    """For each question and model how many samples are missing (only where some are)."""
    all_ = questions.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, models))).alias("model"))
    have = done.groupBy(key, "model").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(have, [key, "model"], "left").select(key, "model", (F.lit(want) - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


CANDIDATE = "sql string, parse_success boolean, parse_method string, generation_seconds double"


def validated(text: Column) -> Column:
    """A candidate record from JSON with defaults for what is missing; broken JSON gives an empty failed record."""
    c = F.from_json(text, CANDIDATE)
    sql = F.coalesce(F.trim(c["sql"]), F.lit(""))
    return F.struct(sql.alias("sql"), F.coalesce(c["parse_success"] & (sql != ""), F.lit(False)).alias("parse_success"), F.coalesce(c["parse_method"], F.lit("none")).alias("parse_method"), F.coalesce(c["generation_seconds"], F.lit(0.0)).alias("generation_seconds"))
