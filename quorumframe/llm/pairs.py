"""Broken prompt and response pairs, each with the one defect it has.

A suffix automaton of the prompt is walked by the answer to measure how much of
the answer is copied and how much of the prompt is given back; a phrase automaton
finds answers that decline; a stack of delimiters finds where an answer stops
(with the prefix join of truncation, for open queries); stopword votes tell the
language of the explaining text. Each answer is parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .answers import Answer, declines, holds_nothing, is_copy, is_cut, read_answer, strays
from .truncation import answers, open_ones


def other_defect(question: str | None, raw: str | None, sql: str | None, a: Answer) -> str:
    """empty, copy, refusal, other_language, or ''."""
    if holds_nothing(raw):
        return "empty" if holds_nothing(sql) else ""
    if is_copy(question, a):
        return "copy"
    if not a.has_query and declines(a.text):
        return "refusal"
    return "other_language" if strays(question, a) else ""


def defect(question: str | None, raw: str | None, sql: str | None) -> str:
    """The defect of one pair, truncation by structure among them; '' for a sound pair."""
    a = read_answer(raw)
    found = other_defect(question, raw, sql, a)
    return "truncated" if found in ("", "other_language") and is_cut(question, sql, a) else found


def defective_pairs(responses: DataFrame, spark: SparkSession) -> DataFrame:
    """(response_id, defect) of each defective pair, one defect each.

    Order where several would fit: empty, copy, refusal, truncated,
    other_language. Null texts count as empty ones; rows with a null id take no
    part; repeated rows count once; other columns are ignored; an empty table
    gives no rows. A null question cannot be copied and has no language.
    """
    found = answers(responses, spark, other_defect)
    settled = found.where("kind not in ('open', 'longer')").select("response_id", F.when(F.col("kind") == "cut", "truncated").otherwise(F.col("kind")).alias("defect"))
    opened = open_ones(found, spark).select("response_id", F.when(F.col("cut"), "truncated").otherwise(F.col("otherwise")).alias("defect"))
    return settled.unionByName(opened.where("defect <> ''")).distinct()
