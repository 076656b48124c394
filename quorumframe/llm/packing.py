"""Filling fixed-capacity containers along a space-filling curve.

1. Sizes: the byte-level tokenizer of ByT5, UTF-8 bytes plus one end token.
2. A text larger than a window is cut, at characters, into pieces that each fill
   a window but the last; other texts are never split.
3. Hashed word counts of a text are projected to three dimensions; their Hilbert
   key orders the pieces, so neighbours on the curve have related words.
4. Rows are range-partitioned by (window, key) and packed in one pass with a
   bounded number of open containers, each piece going where it leaves least room.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import spread, written

HASHED, DIMS, BITS, OPEN = 256, 3, 10, 256
WORD = re.compile(r"[^\W_]+")
PIECES = "doc_id bigint, window_id int, capacity int, piece int, n_pieces int, tokens int, first_byte int, last_byte int, hilbert bigint"
PACKED = "window_id int, container string, doc_id bigint, piece int, n_pieces int, tokens int, first_byte int, last_byte int, capacity int"


def projection() -> np.ndarray:
    """Fixed signs that take hashed counts to a few dimensions."""
    return np.random.default_rng(20).choice([-1.0, 1.0], size=(HASHED, DIMS))


@lru_cache(200_000)
def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % HASHED


def hashed_counts(text: str) -> np.ndarray:
    return np.bincount([bucket(w) for w in WORD.findall(text.lower())] or [0], minlength=HASHED).astype(float)


def cells(vectors: np.ndarray) -> np.ndarray:
    """Projected vectors of unit length -> grid cells of BITS bits a dimension, through the logistic curve."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    p = vectors / np.where(norm == 0, 1, norm) @ projection()
    return np.minimum((2**BITS / (1 + np.exp(-1.7 * p))).astype(np.int64), 2**BITS - 1)


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of cells (the transpose form: undo, Gray code, interleave)."""
    x = x.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def cut_points(data: bytes, room: int) -> list[int]:
    """Ends of the pieces of at most `room` bytes, never inside a character."""
    ends, at = [], 0
    while len(data) - at > room:
        end = at + room
        while end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            raise ValueError("a window must hold one character and the end token")
        ends.append(end)
        at = end
    return [*ends, len(data)]


def make_pieces(windows: list[tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            keys = hilbert_keys(cells(np.stack([hashed_counts(t) for t in df.text])))
            out = []
            for d, t, key in zip(df.doc_id, df.text, keys.tolist()):
                data = t.encode("utf-8", "surrogatepass")
                for w, capacity in windows:
                    ends = cut_points(data, capacity - 1)
                    for k, (a, b) in enumerate(zip([0, *ends], ends)):
                        out.append((d, w, capacity, k, len(ends), b - a + 1, a, b, key))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])

    return run


def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition in curve order: best fit among at most OPEN containers; a closed one is not opened again."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    window, rooms, names, made = None, np.zeros(0, np.int64), [], 0
    for df in batches:
        where = []
        for w, capacity, tokens in zip(df.window_id, df.capacity, df.tokens):
            if w != window:
                window, rooms, names = w, np.zeros(0, np.int64), []
            left = rooms - tokens
            fits = np.flatnonzero(left >= 0)
            if len(fits):
                k = int(fits[np.argmin(left[fits])])
                rooms[k] = left[k]
            else:
                if len(names) >= OPEN:
                    k = int(np.argmin(rooms))
                else:
                    k, names, rooms = len(names), [*names, ""], np.append(rooms, 0)
                names[k], rooms[k] = f"{w}-{part}-{made}", capacity - tokens
                made += 1
            where.append(names[k])
        yield df.assign(container=where)[[x.split()[0] for x in PACKED.split(", ")]]


def pack(documents: DataFrame, windows: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", window_id: str = "window_id", capacity: str = "capacity_tokens") -> DataFrame:
    """The assignment of texts, or pieces of them, to containers of each window size.

    Rows: window_id, container, doc_id, piece (from 0), n_pieces, tokens (with
    the end token), first_byte and last_byte (exclusive) of the UTF-8 text, and
    capacity. Null and empty texts have no size and no row; blank texts have
    both. Windows with a null or repeated id or capacity count once or not at
    all. Empty tables give no rows; repeated documents are packed each time;
    extra columns are ignored. Windows are settings: more than 1000 are refused.
    """
    sizes = [(int(r[0]), int(r[1])) for r in windows.select(window_id, capacity).where(f"{window_id} is not null and {capacity} is not null").distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("more than 1000 windows")
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    # Written, as choosing the ranges reads the pieces once more.
    pieces = written(spread(docs).mapInPandas(make_pieces(sorted(sizes)), PIECES), "pieces", spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(n, "window_id", "hilbert", "doc_id", "piece").sortWithinPartitions("window_id", "hilbert", "doc_id", "piece")
    return ordered.mapInPandas(fill, PACKED)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each window: containers, tokens in them and the share of room left unused."""
    each = packed.groupBy("window_id", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return each.groupBy("window_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(1 - F.sum("used") / F.sum("capacity"), 4).alias("unused")
    )
