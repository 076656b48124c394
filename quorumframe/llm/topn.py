"""Top N items within every group by mergeable bounded heaps.

The aggregate keeps at most N (score, item) pairs for a group in a bounded
priority queue. Spark updates the queues on the map side, ships only the queues
and merges them after the shuffle, so a group of any size costs N pairs for each
map task. Ties of the score are broken by the item, which is unique in its group
after the max step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.operators.pool import heap


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 3, rank: str = "rnk") -> DataFrame:
    """Per group the n items of the highest score: rows (group, item, score, rank from 1).

    An item's score is the highest on any of its rows, so repeated rows change
    nothing. Equal scores: the larger item first. Rows with a null group, item or
    score take no part; an empty input gives no rows; a group of fewer than n
    items gives all of them. Other columns of df are ignored, whatever their
    names. Both steps pre-aggregate before their shuffle: the max step is keyed
    by (group, item), which spreads a hot group over all partitions, and the
    heap step sends at most n pairs of a group from a task.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where(
        "g is not null and i is not null and s is not null"
    )
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    heaps = best.groupBy("g").agg(heap(F.struct("s", "i"), n).alias("heap"))
    return heaps.select("g", F.posexplode("heap").alias("p", "h")).select(
        F.col("g").alias(group), F.col("h.i").alias(item), F.col("h.s").alias(score), (F.col("p") + 1).cast("int").alias(rank)
    )
