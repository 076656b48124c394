"""Text cut off by limits: open ends, and queries that are strict prefixes of a longer copy elsewhere.

1. A text is cut off if its own structure lacks an end (open blocks, unfinished
   query or sentence, no answer at all). This decides alone: the end of a text
   that is cut off need not go on in any other text.
2. A bare query that may end where it does, or go on (cut between two clauses),
   is decided by the sql taken from it. Where that is missing or another one,
   the text is cut off if it is a strict prefix of another response to the same
   question, taken up to the end of the query there: a semicolon or an
   explanation after the same query does not make the first one cut.
3. The undecided texts and the texts with a bare query are sorted together by
   range partitions. A text is a strict prefix of a longer one exactly if the
   next one in the order begins with it, so one pass over each partition
   decides, with a stack of texts that are prefixes of each other; the
   partitions' borders are settled from a few rows of each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import spread, written

from .answers import BLANK, Answer, is_cut, query_state, read_answer


def flat(text: str | None) -> str:
    """On one line, without the semicolon of a last query."""
    return BLANK.sub(" ", text or "").strip().rstrip("; ")


def undecided(sql: str | None, a: Answer) -> bool:
    """Whether an answer that is_cut lets pass ends in a query that may go on, and its sql does not say that it ends there."""
    return a.ends == "query" and query_state(a.bare[-1]) == "open" and flat(a.bare[-1]) != flat(sql)


READ = "response_id bigint, value string, kind string, otherwise string"
READ_NAMES = [x.split()[0] for x in READ.split(", ")]


def read(judge: Callable[[str | None, str | None, str | None, Answer], str] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each answer parsed once.

    kind cut: an id settled by structure; open: an id and its undecided text;
    longer: a text up to the end of a bare query (without an id, each once a
    batch). judge names another defect of an answer: one that comes before
    truncation is its kind, one that comes after it stands in otherwise.
    Texts follow their question, so that only answers to the same one are compared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            longer: set[str] = set()
            rows: list[tuple] = []
            for i, question, raw, sql in zip(df.response_id, df.question, df.raw_response, df["sql"]):
                a = read_answer(raw)
                found = judge(question, raw, sql, a) if judge else ""
                early = found in BEFORE
                if early:
                    rows.append((i, None, found, ""))
                if not a.text:
                    continue
                upto = [f"{flat(question)}\x1f{flat(a.text[:end])}" for end in a.bare_ends]
                longer.update(upto)
                if early:
                    continue
                if is_cut(question, sql, a):
                    rows.append((i, None, "cut", ""))
                elif undecided(sql, a):
                    rows.append((i, upto[-1], "open", found))
                elif found:
                    rows.append((i, None, found, ""))
            rows += [(None, v, "longer", "") for v in longer]
            yield pd.DataFrame(rows, columns=READ_NAMES).astype({"response_id": "Int64"})

    return run


# Defects that an answer has rather than being cut off.
BEFORE = frozenset({"empty", "copy", "refusal"})


MARK = "value string, kind string"


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted distinct values of one partition -> prefixes found, and what the border needs.

    kind: prefix (settled), pending (no longer value in this partition follows), first (the first longer value).
    """
    stack: list[str] = []
    seen = False
    for df in batches:
        out = []
        for v, short, long in zip(df.value, df.short, df.long):
            while stack and not v.startswith(stack[-1]):
                stack.pop()
            if long:
                if not seen:
                    out.append((v, "first"))
                    seen = True
                out += [(s, "prefix") for s in stack]
                stack = []
            if short:
                stack.append(v)
        yield pd.DataFrame(out, columns=["value", "kind"])
    yield pd.DataFrame([(s, "pending") for s in stack], columns=["value", "kind"])


def close_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pending and first values of all partitions in order -> the pending ones that the next first value begins with."""
    stack: list[str] = []
    for df in batches:
        out = []
        for v, kind in zip(df.value, df.kind):
            if kind == "pending":
                stack.append(v)
            else:
                out += [(s,) for s in stack if v != s and v.startswith(s)]
                stack = []
        yield pd.DataFrame(out, columns=["value"])


def strict_prefixes(short: DataFrame, long: DataFrame, spark: SparkSession, partitions: int | None = None) -> DataFrame:
    """Distinct values of short that are strict prefixes of a value of long (column `value` of each).

    Nulls and empty values take no part; repeated values count once; equal
    values are no strict prefixes; empty tables give no rows.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = short.select("value", F.lit(True).alias("short"), F.lit(False).alias("long")).unionByName(long.select("value", F.lit(False).alias("short"), F.lit(True).alias("long")))
    each = both.where("value <> ''").groupBy("value").agg(F.max("short").alias("short"), F.max("long").alias("long"))
    marked = written(each.repartitionByRange(n, "value").sortWithinPartitions("value").mapInPandas(walk, MARK), "prefixes", spark)
    # At most one first value and one chain of nested prefixes for each partition.
    border = marked.where("kind <> 'prefix'").repartition(1).sortWithinPartitions("value", F.expr("kind = 'pending'")).mapInPandas(close_borders, "value string")
    return marked.where("kind = 'prefix'").select("value").unionByName(border).distinct()


def answers(responses: DataFrame, spark: SparkSession, judge=None) -> DataFrame:
    """What read() finds, written: the texts are parsed once, whatever is asked of them."""
    rows = responses.select(F.col("response_id").cast("bigint").alias("response_id"), "question", "raw_response", "sql").where("response_id is not null")
    return written(spread(rows).mapInPandas(read(judge), READ), "ends", spark)


def open_ones(found: DataFrame, spark: SparkSession) -> DataFrame:
    """(response_id, otherwise, cut) of the undecided answers: whether each is a strict prefix of a longer copy.

    Answers are joined by their distinct texts. One text may be that of many
    responses, so texts with more than a thousandth of the open answers (fewer
    than a thousand texts, broadcast) are joined apart from the rest.
    """
    opened = found.where("kind = 'open'")
    cut = strict_prefixes(opened.select("value"), found.where("kind = 'longer'").select("value"), spark)
    counts = opened.groupBy(F.xxhash64("value").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.greatest(F.lit(1000), F.col("t") / 1000)).select("h")
    marked = opened.withColumn("h", F.xxhash64("value")).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left")
    mine = cut.withColumn("h", F.xxhash64("value")).withColumn("cut", F.lit(True))
    few = F.broadcast(mine.join(F.broadcast(hot), "h", "left_semi").drop("h"))
    both = marked.where("hot").join(few, "value", "left").unionByName(marked.where("hot is null").join(mine.drop("h").hint("merge"), "value", "left"))
    return both.select("response_id", "otherwise", F.coalesce("cut", F.lit(False)).alias("cut"))


def cut_off(responses: DataFrame, spark: SparkSession) -> DataFrame:
    """response_id of the responses whose raw_response was cut off, each once.

    Needs response_id, question, raw_response and sql; other columns are
    ignored. Null and blank texts, and rows with a null id, are not cut off;
    repeated rows count once; an empty table gives no rows. Texts of any length
    are read whole.
    """
    found = answers(responses.where("raw_response is not null"), spark)
    return found.where("kind = 'cut'").select("response_id").unionByName(open_ones(found, spark).where("cut").select("response_id")).distinct()


def signals(responses: DataFrame, spark: SparkSession) -> DataFrame:
    """Per response with a text: by_structure (the text lacks its own end) and by_prefix (the whole text is a strict prefix of another response's).

    The prefix join alone, over whole texts, as a second signal: it needs that
    the longer copy was delivered too, and holds of whole answers that another
    one goes on from. Rules for odd rows as in cut_off.
    """
    texts = responses.select(F.col("response_id").cast("bigint").alias("response_id"), "raw_response").where("response_id is not null and trim(raw_response) <> ''").distinct()
    structure = answers(responses.where("raw_response is not null"), spark).where("kind = 'cut'").select("response_id", F.lit(True).alias("s")).distinct()
    values = texts.select(F.rtrim("raw_response").alias("value"))
    prefix = strict_prefixes(values, values, spark).withColumn("p", F.lit(True))
    j = texts.withColumn("value", F.rtrim("raw_response")).join(prefix, "value", "left").join(structure, "response_id", "left")
    return j.groupBy("response_id").agg(F.max(F.coalesce("s", F.lit(False))).alias("by_structure"), F.max(F.coalesce("p", F.lit(False))).alias("by_prefix"))


def share_by_source(responses: DataFrame, cut: DataFrame) -> DataFrame:
    """For each source: responses, those cut off and their share. A null source is a source of its own.

    Responses are counted once each in two steps, first by id, so a source that
    holds most rows is not counted in one task.
    """
    once = responses.where("response_id is not null").select("source", F.col("response_id").cast("bigint").alias("response_id")).distinct()
    both = once.join(cut.withColumn("hit", F.lit(1)), "response_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_responses"), F.count("hit").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_responses"), 4))
