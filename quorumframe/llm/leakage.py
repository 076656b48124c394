"""Evaluation texts leaking into training text: an FM-index for each training shard.

A document holds a passage of an item if RUN words of the item follow each other
in it. The phrases are all RUN-word windows of the items. Each task cuts its
documents into shards, indexes a shard, searches all phrases backwards at once,
locates the hits and merges them into removal spans. Words that no phrase has
cannot lie in a hit; a run of them stands as one separator, and stretches of
fewer than RUN phrase words are left out, so the index holds only what a hit can
touch. Documents are never compared with each other and never shuffled.

The items are a stated query set. They are taken in blocks of at most BLOCK_WORDS
words, the bound of what is sent to a task; each block is searched against all
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import spread

from .fmindex import FMIndex

WORD = re.compile(r"[^\W_]+")
RUN, SHARD_WORDS, BLOCK_WORDS = 12, 400_000, 2_000_000
SPANS = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint"


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


class Phrases:
    """All RUN-word windows of a block of items, as numbers."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        self.run = run
        self.vocabulary: dict[str, int] = {}  # from 2: 0 ends a text, 1 separates
        index: dict[tuple, set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for k in range(len(ids) - run + 1):
                index.setdefault(tuple(ids[k : k + run]), set()).add(item)
        self.patterns = np.array(list(index), np.int32).reshape(len(index), run)
        # Items of pattern k: item_ids[item_at[k] : item_at[k + 1]].
        self.item_at = np.cumsum([0, *map(len, index.values())])
        self.item_ids = np.array([i for v in index.values() for i in sorted(v)], np.int64)
        self.alphabet = len(self.vocabulary) + 2

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Symbols of the stretches of a text that can hold a phrase, and the word number of each (-1: separator)."""
        known = self.vocabulary
        ids = [known.get(w, 1) for w in words(text)]
        symbols: list[int] = []
        at: list[int] = []
        k, n = 0, len(ids)
        while k < n:
            if ids[k] == 1:
                k += 1
                continue
            j = k
            while j < n and ids[j] != 1:
                j += 1
            if j - k >= self.run:
                symbols += ids[k:j]
                symbols.append(1)
                at += range(k, j)
                at.append(-1)
            k = j
        return symbols, at


def merge_spans(starts: list[int], run: int) -> list[tuple[int, int]]:
    """Windows of `run` words from sorted starts -> disjoint spans (first, last word)."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], s + run - 1)
        else:
            out.append([s, s + run - 1])
    return [(a, b) for a, b in out]


def search_shard(docs: list[tuple[int, list[int], list[int]]], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """Index the encoded documents and return (doc, item, first word, last word) of each merged span."""
    if not docs or not len(phrases.patterns):
        return []
    text = np.concatenate([np.asarray(s, np.int64) for _, s, _ in docs])
    where = np.concatenate([np.asarray(a, np.int64) for _, _, a in docs])
    owner = np.repeat(np.arange(len(docs)), [len(s) for _, s, _ in docs])
    index = FMIndex(text, phrases.alphabet)
    lo, hi = index.search(phrases.patterns)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return []
    counts = (hi - lo)[found]
    rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    at = index.locate(rows)
    hits: dict[tuple[int, int], list[int]] = {}
    for p, pattern in zip(at.tolist(), np.repeat(found, counts).tolist()):
        for item in phrases.item_ids[phrases.item_at[pattern] : phrases.item_at[pattern + 1]].tolist():
            hits.setdefault((int(owner[p]), item), []).append(int(where[p]))
    return [(docs[d][0], item, a, b) for (d, item), starts in hits.items() for a, b in merge_spans(sorted(starts), phrases.run)]


def leaked_spans(documents: DataFrame, items: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", run: int = RUN) -> DataFrame:
    """Removal spans (doc_id, item_id, first_word, last_word), words counted from 0.

    Null and empty texts, and items shorter than `run` words, give no rows; an
    empty table on either side gives none; repeated rows repeat their spans;
    items may share phrases, and each is reported; extra columns are ignored. A
    text longer than a shard makes a shard of its own and is never cut.
    """
    listed = items.select(F.col(item_id).cast("bigint"), F.col(item_text)).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for i, t in listed.toLocalIterator():
        n = len(words(t))
        if size and size + n > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((i, t))
        size += n
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(Phrases(block, run))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            phrases = shared.value
            shard: list[tuple[int, list[int], list[int]]] = []
            held = 0
            for df in batches:
                for d, t in zip(df.doc_id, df.text):
                    symbols, at = phrases.encode(t)
                    if symbols:
                        shard.append((d, symbols, at))
                        held += len(symbols)
                    if held >= SHARD_WORDS:
                        yield pd.DataFrame(search_shard(shard, phrases), columns=SPAN_COLUMNS)
                        shard, held = [], 0
            yield pd.DataFrame(search_shard(shard, phrases), columns=SPAN_COLUMNS)

        found = spread(docs).mapInPandas(scan, SPANS)
        out = found if out is None else out.unionByName(found)
    return out


SPAN_COLUMNS = [x.split()[0] for x in SPANS.split(", ")]
