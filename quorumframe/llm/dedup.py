"""Duplicates hidden by formatting: canonical queries, Bloom filters, exact grouping.

1. Every query is brought to a canonical token text, hashed to 128 bits and
   written, with its id, as a narrow table.
2. The hashes are cut into ranges, each small enough for a filter of at most
   MAX_BITS; with more than one range the table is written by range, so each pass
   reads its own part. In a pass, tasks fold blocks of FLUSH rows into two bit
   arrays, bits of hashes seen and bits seen more than once, cut into segments and
   merged by segment: twice = twice_a | twice_b | (once_a & once_b). The merge is
   exact about repeats: a hash in two blocks has all its bits in the result.
3. Only rows whose bits are all set are shuffled for exact grouping by the
   128-bit hash; the others are singletons and stay where they are.

The number of passes grows with the rows, so the share of singletons that are
shuffled stays under a hundredth at every size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import spread, written

TOKEN = re.compile(
    r"""(?P<s>'(?:[^']|'')*(?:'|\Z))|(?P<d>"(?:[^"]|"")*(?:"|\Z))|(?P<b>`[^`]*(?:`|\Z))|(?P<k>\[[^\]]*(?:\]|\Z))|(?P<n>\d+(?:\.\d+)?(?:e[+-]?\d+)?|\.\d+)|(?P<w>[^\W\d]\w*)|(?P<o><=|>=|<>|!=|==|\|\||[^\s\w])""",
    re.S,
)
# Words that end the select list or the WHERE clause at the same depth.
SELECT_END = frozenset({"from", "union", "intersect", "except"})
WHERE_END = frozenset({"group", "having", "order", "limit", "offset", "union", "intersect", "except", "window", "qualify"})
COMPARES = frozenset({"=", "==", "!=", "<>", "<", ">", "<=", ">=", "like", "glob", "between", "||", "then", "else"})
SEP = "\x1f"


def tokens(sql: str) -> list[str]:
    """Lower-case tokens; quoted identifiers bare, strings with one leading quote and their own characters."""
    found = [(m.lastgroup, m.group()) for m in TOKEN.finditer(sql.lower())]
    out: list[str] = []
    stack: list[bool] = []  # for each open bracket: does it hold a list of values
    for i, (kind, t) in enumerate(found):
        if kind == "s":
            out.append("'" + t[1:].removesuffix("'").replace("''", "'"))
        elif kind == "d":
            text = t[1:].removesuffix('"').replace('""', '"')
            last = out[-1] if out else ""
            dotted = last == "." or i + 1 < len(found) and found[i + 1][1] == "."
            value = last in COMPARES or (last in "(," and stack and stack[-1]) or (last == "and" and len(out) > 2 and out[-3] == "between")
            out.append(text if dotted or not value else "'" + text)
        elif kind in "bk":
            out.append(t[1:-1] if t[-1] in "`]" and len(t) > 1 else t[1:])
        elif kind == "o":
            if t == "=" and out and out[-1] in ("<", ">", "!") and found[i - 1][1] == out[-1]:
                out[-1] += t
                continue
            if t == "(":
                stack.append(bool(out) and out[-1] == "in")
            elif t == ")" and stack:
                stack.pop()
            out.append(t)
        else:
            out.append(t)
    return out


def split_top(ts: list[str], at: str) -> list[list[str]]:
    """Pieces between `at` outside brackets; the AND of a BETWEEN does not split."""
    parts: list[list[str]] = [[]]
    depth = between = 0
    for t in ts:
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        if depth == 0:
            if t == "between":
                between += 1
            elif t == at == "and" and between:
                between -= 1
            elif t == at:
                parts.append([])
                continue
        parts[-1].append(t)
    return parts


def cases_folded(ts: list[str]) -> list[str]:
    """Each CASE ... END as one token, inner ones with the outer; one without its END stays as it is."""
    out: list[str] = []
    opened: list[int] = []
    for t in ts:
        out.append(t)
        if t == "case":
            opened.append(len(out) - 1)
        elif t == "end" and opened:
            k = opened.pop()
            out[k:] = [SEP.join(out[k:])]
    return out


def settled(ts: list[str]) -> list[str]:
    """Canonical order of one query's tokens: select items and AND-ed conditions sorted, inner queries first."""
    flat: list[str] = []  # brackets become one token
    i = 0
    while i < len(ts):
        if ts[i] == "(":
            depth, j = 1, i + 1
            while j < len(ts) and depth:
                depth += (ts[j] == "(") - (ts[j] == ")")
                j += 1
            closed = depth == 0
            inner = ts[i + 1 : j - 1 if closed else j]
            flat.append("(" + SEP + SEP.join(settled(inner)) + (SEP + ")" if closed else ""))
            i = j
        else:
            flat.append(ts[i])
            i += 1
    flat = cases_folded(flat)
    out: list[str] = []
    i = 0
    while i < len(flat):
        t = flat[i]
        out.append(t)
        i += 1
        if t == "select":
            if i < len(flat) and flat[i] in ("distinct", "all"):
                out.append(flat[i])
                i += 1
            j = i
            while j < len(flat) and flat[j] not in SELECT_END:
                j += 1
            items = sorted(split_top(flat[i:j], ","))
            for k, item in enumerate(items):
                out += ([","] if k else []) + item
            i = j
        elif t == "where":
            j = i
            while j < len(flat) and flat[j] not in WHERE_END:
                j += 1
            body = flat[i:j]
            if "or" not in body and "case" not in body:
                for k, item in enumerate(sorted(split_top(body, "and"))):
                    out += (["and"] if k else []) + item
            else:
                out += body
            i = j
    return out


def canonical_sql(sql: str | None) -> str | None:
    """Canonical text of a query; None for a null, blank or only-semicolon text.

    Two queries have the same text if they differ only in whitespace, letter
    case, closing semicolons, quoting, the order of select items, or the order
    of AND-ed conditions of a WHERE without OR outside brackets and CASE. Inside a
    CASE, and in a WHERE with a CASE that has no END, conditions keep their order.
    """
    if sql is None:
        return None
    ts = tokens(sql)
    while ts and ts[-1] == ";":
        ts.pop()
    return SEP.join(settled(ts)) if ts else None


BITS_PER_ROW, MIN_BITS, MAX_BITS, SEGMENT_BITS, PROBES, FLUSH = 16, 1 << 20, 1 << 28, 1 << 20, 3, 1 << 20


def filter_plan(rows: int) -> tuple[int, int]:
    """(passes, bits of each pass's filter): 16 bits a row, a power of two from MIN_BITS to MAX_BITS, and as many ranges of hashes as that takes."""
    passes = -(-max(1, rows) * BITS_PER_ROW // MAX_BITS)
    # Ranges differ a little in size; a range of a few rows more only fills its filter a little more.
    return passes, min(MAX_BITS, max(MIN_BITS, 1 << (max(1, -(-rows // passes)) * BITS_PER_ROW - 1).bit_length()))


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """PROBES bit positions of each 64-bit hash, all in one segment."""
    u = h.view(np.uint64)
    segment = (u >> np.uint64(40)) % np.uint64(bits // SEGMENT_BITS) * np.uint64(SEGMENT_BITS)
    a, b = u & np.uint64(0xFFFFF), (u >> np.uint64(20)) & np.uint64(0xFFFFF) | np.uint64(1)
    return [segment + (a + np.uint64(i) * b) % np.uint64(SEGMENT_BITS) for i in range(PROBES)]


def segments_of(h: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Bits of a block of hashes by segment: (segment, once, twice)."""
    h, n = np.unique(h, return_counts=True)
    at = np.stack(positions(h, bits), axis=1).astype(np.int64)
    order = np.argsort(at[:, 0] // SEGMENT_BITS, kind="stable")
    at, n = at[order], n[order]
    cuts = np.searchsorted(at[:, 0] // SEGMENT_BITS, np.arange(bits // SEGMENT_BITS + 1))
    for s in range(bits // SEGMENT_BITS):
        own = at[cuts[s] : cuts[s + 1]] - s * SEGMENT_BITS
        if len(own):
            once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            once[own.ravel()] = True
            twice[own[n[cuts[s] : cuts[s + 1]] > 1].ravel()] = True
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(np.packbits(once).tobytes(), 1)], "twice": [zlib.compress(np.packbits(twice).tobytes(), 1)]})


def partial_filters(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hash column -> (segment, once, twice) of each block of at most about FLUSH rows, the bound of what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= FLUSH:
                yield from segments_of(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield from segments_of(np.concatenate(held), bits)

    return run


def merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial filters sorted by segment -> the bits seen twice of each segment. Memory: two segments."""
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})

    for b in batches:
        for s, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
            if s == now:
                twice = twice | t | (once & o)
                once = once | o
            else:
                if now is not None:
                    yield done()
                now, once, twice = s, o, t
    if now is not None:
        yield done()


class RepeatFilter:
    """The merged filter over a hash column: which rows may share their hash with another row."""

    def __init__(self, hashed: DataFrame, bits: int, spark: SparkSession, column: str = "h1") -> None:
        self.bits, self.column = bits, column
        parts = hashed.select(column).mapInArrow(partial_filters(bits), "segment int, once binary, twice binary")
        n = min(bits // SEGMENT_BITS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        merged = parts.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(merge_filters, "segment int, twice binary")
        # At most MAX_BITS / 8 = 32 MiB, whatever the data.
        self.shared = spark.sparkContext.broadcast({r.segment: bytes(r.twice) for r in merged.collect()})

    def flagged(self, df: DataFrame) -> DataFrame:
        """Rows with `again`: whether their hash may occur again (true of all that do, and of few others)."""
        k, bits, shared = df.columns.index(self.column), self.bits, self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            twice = np.zeros(bits // 8, np.uint8)
            for s, z in shared.value.items():
                twice[s * SEGMENT_BITS // 8 : (s + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(z), np.uint8)
            for b in batches:
                h = b.column(k).to_numpy(zero_copy_only=False)
                hit = np.ones(len(h), bool)
                for p in positions(h, bits):
                    hit &= (twice[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, "again"])

        return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", again boolean")


def hash_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, db, sql) -> (id, h1, h2); the same raw text is canonicalised once a batch."""
    for b in batches:
        known: dict[str, str | None] = {}
        ids, h1, h2 = [], [], []
        for i, db, sql in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if sql not in known:
                known[sql] = canonical_sql(sql)
            c = known[sql]
            if c is not None:
                d = hashlib.blake2b(f"{(db or '').strip().lower()}\x1e{c}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                ids.append(i)
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "h1", "h2"])


HOT_GROUPS = 100_000


class Copies:
    """Copies among queries: .pairs() and .records(). See module docstring.

    Rows with a null id take no part; null, blank and only-semicolon texts are
    left out; a null db counts as an empty one; a row delivered twice counts
    once; extra columns are ignored; an empty input gives empty results.
    """

    def __init__(self, df: DataFrame, spark: SparkSession, id_: str = "id", db: str = "db_id", sql: str = "sql_text") -> None:
        rows = df.select(F.col(id_).cast("bigint").alias("id"), F.col(db).alias("db"), F.col(sql).alias("sql")).where("id is not null and trim(sql) <> ''")
        hashed = spread(rows).mapInArrow(hash_queries, "id bigint, h1 bigint, h2 bigint")
        self.passes, self.bits = filter_plan(df.count())
        if self.passes > 1:  # ranges of the upper 16 bits
            hashed = hashed.withColumn("part", F.floor(F.shiftrightunsigned("h1", 48) * self.passes / 65536).cast("int"))
        hashed = written(hashed, "canonical", spark, *(["part"] if self.passes > 1 else []))
        self.flags = None
        for k in range(self.passes):
            own = hashed.where(f"part = {k}").drop("part") if self.passes > 1 else hashed
            repeated = RepeatFilter(own, self.bits, spark)
            marked = written(repeated.flagged(own), "flags", spark)
            repeated.shared.destroy()
            self.flags = marked if self.flags is None else self.flags.unionByName(marked)
        self.repeats = self.flags.where("again").drop("again").dropDuplicates(["h1", "h2", "id"])
        self.groups = self.repeats.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))

    def pairs(self) -> DataFrame:
        """(keep_id, copy_id): the smallest id of a group with each other id in it.

        Groups of more than a 100,000th of the rows (fewer than HOT_GROUPS by
        count, three numbers each) are joined by broadcast, so no hot group
        meets in one task.
        """
        limit = max(1000, self.flags.count() // HOT_GROUPS)
        many = self.groups.where("n_copies > 1")
        hot = F.broadcast(many.where(F.col("n_copies") > limit).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("keep_id").alias("k")))
        on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
        marked = self.repeats.join(hot, on, "left")
        of_hot = marked.where("k is not null").select(F.col("k").alias("keep_id"), F.col("id").alias("copy_id"))
        rest = marked.where("k is null").select("h1", "h2", "id").join(many.where(F.col("n_copies") <= limit), ["h1", "h2"]).select("keep_id", F.col("id").alias("copy_id"))
        return of_hot.unionByName(rest).where("keep_id < copy_id")

    def records(self) -> DataFrame:
        """(keep_id, n_copies): one row for each distinct query; sure singletons come without a shuffle."""
        singles = self.flags.where("not again").select(F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_copies"))
        return self.groups.select("keep_id", "n_copies").unionByName(singles)
