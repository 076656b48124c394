"""Execution of many query texts over small database instances, on the executors.

A database is a set of instances, each a SQLite file image of bounded size. Texts
and images are brought together by (database, slice): a database with many texts
is cut into slices of about SLICE texts, so no database meets in one task; its
images, which are small, are sent to each slice. A task takes the slice's texts
in blocks: each is compiled once and runs over all instances, whose rows follow
each other in one database (see Instances). What leaves a task is one row a
text: signatures, flags and failures, never rows.

Runs are guarded: read-only texts only, one statement, no writes, a step budget
that stops a text at the same place on every machine, a deadline beside it, and
a cap on kept rows beyond which rows are still counted.
"""

from __future__ import annotations

import hashlib
import itertools
import marshal
import os
import re
import sqlite3
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.functions import sqltext
from quorumframe.functions.textops import FORBIDDEN, STARTS
from quorumframe.operators.equality import permutations_fit
from quorumframe.session import written

from .rowsets import HAS_CELL, HAS_NONZERO, HAS_NUMBER, MOST_ROWS, Found, RowSets, Shape, Table, places

SLICE = 4096
# Kept rows, virtual machine steps of one text, steps between two looks at the clock, seconds.
CAP, STEPS, TICK, TIMEOUT = 100_000, 5_000_000, 1000, 30.0


@dataclass
class Limits:
    cap: int = CAP
    steps: int = STEPS
    timeout: float = TIMEOUT


@dataclass
class Run:
    """Result of one text on one instance: at most cap rows, the number of all rows, or a failure."""

    rows: list[tuple] | None = None
    count: int = 0
    error_type: str = ""
    error: str = ""
    columns: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return self.rows is not None

    def truncated(self, cap: int) -> bool:
        return self.ok and self.count > cap


def refusal(sql: str | None) -> Run | None:
    """The failure of a text that is never run: empty, not read-only, or several statements."""
    if not (sql or "").strip():
        return Run(error_type="empty_sql", error="empty text")
    words = [t.upper() for t in sqltext.scan(sql) if not t.startswith("'")]
    if not words or words[0] not in STARTS or not NOT_RUN.isdisjoint(words):
        return Run(error_type="safety_rejection", error="only single read-only queries are run")
    if sqltext.is_multi_statement(sql):
        return Run(error_type="multi_statement", error="several statements")
    return None


NOT_RUN = frozenset(FORBIDDEN)
NOT_RUN_LOWER = frozenset(x.lower() for x in FORBIDDEN)


def open_image(image: bytes) -> sqlite3.Connection:
    """A read-only connection to a database image in memory."""
    con = sqlite3.connect(":memory:", isolation_level=None)
    con.deserialize(image)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    con.execute("PRAGMA query_only = ON")
    return con


def run_all(cons: list[sqlite3.Connection], sql: str | None, limits: Limits) -> list[Run]:
    """Run one text on every connection, if it may be run at all."""
    refused = refusal(sql)
    return [refused] * len(cons) if refused else [run_allowed(c, sql, limits) for c in cons]


def run_text(con: sqlite3.Connection, sql: str | None, limits: Limits) -> Run:
    """Run one text, if it may be run at all."""
    return run_all([con], sql, limits)[0]


def run_allowed(con: sqlite3.Connection, sql: str, limits: Limits) -> Run:
    """Run a read-only text. Steps beyond the budget give query_interrupted, time beyond the deadline timeout, all else that fails sqlite_error."""
    ticks, late, until = 0, "", time.monotonic() + limits.timeout

    def watch() -> int:
        nonlocal ticks, late
        ticks += TICK
        if ticks > limits.steps:
            late = "query_interrupted"
        elif time.monotonic() > until:
            late = "timeout"
        return int(bool(late))

    con.set_progress_handler(watch, TICK)
    try:
        cur = con.execute(sql)
        rows = cur.fetchmany(limits.cap + 1)
        count = len(rows)
        while count > limits.cap and (more := cur.fetchmany(10_000)):
            count += len(more)
        return Run(rows[: limits.cap], count, columns=tuple(d[0] for d in cur.description or ()))
    except (sqlite3.Error, sqlite3.Warning, ValueError, OverflowError) as e:
        return Run(error_type=late or "sqlite_error", error=str(e)[:300])
    finally:
        con.set_progress_handler(None, 0)


def digest(parts: list[str]) -> str:
    return hashlib.blake2b("\x1e".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def sign(run: Run, cap: int) -> tuple[str, str, int]:
    """Signature as a bag of rows, signature in order, and flags of the cells. Cells keep their type: 1, 1.0 and '1' differ."""
    if not run.ok:
        return "ERROR", "ERROR", 0
    if not run.rows:
        return NO_ROWS
    texts = [repr(r) for r in run.rows]
    mark = ["TRUNC"] if run.truncated(cap) else []
    if len(texts) == 1 and not mark:
        one = digest(texts)
        return one, one, flags_of(run.rows)
    return digest(sorted(texts) + mark), digest(texts + mark), flags_of(run.rows)


def flags_of(rows: list[tuple]) -> int:
    """What kinds of cells rows have."""
    flags = HAS_CELL if any(rows) else 0
    for r in rows:
        for v in r:
            if isinstance(v, (int, float)):
                flags |= HAS_NUMBER | (HAS_NONZERO if abs(v) >= 1e-12 else 0)
        if flags == HAS_CELL | HAS_NUMBER | HAS_NONZERO:
            break
    return flags


NO_ROWS = digest([]), digest([]), 0


class Signer:
    """sign() with equal results signed once; what is kept is dropped when it grows too large."""

    def __init__(self, cap: int):
        self.cap, self.known = cap, {}

    def __call__(self, run: Run) -> tuple[str, str, int]:
        if not run.rows or run.count > KEPT_ROWS:
            return sign(run, self.cap)
        key = marshal.dumps(run.rows, 2)  # tells types of cells apart
        if (out := self.known.get(key)) is None:
            if len(self.known) >= KEPT_RESULTS:
                self.known.clear()
            out = self.known[key] = sign(run, self.cap)
        return out


# Rows of a result and number of results that are kept for Signer; texts compiled at a time; bytes of an image that is staged.
KEPT_ROWS, KEPT_RESULTS, BLOCK, STAGED = 200, 50_000, 1024, 1 << 20
# Words of texts whose answer may depend on more than the rows.
BEYOND_ROWS = re.compile(r"sqlite_|pragma|dbstat|changes|last_insert|explain", re.I)
NAMES = itertools.count()


def canonical(sql: str, names: frozenset[str]) -> tuple[str, ...] | None:
    """Tokens of a text that SQLite reads alike: blanks, letter case of bare words and brackets or backticks round names brought to one form.

    None for texts with signs whose meaning could depend on the blanks between them.
    """
    out: list[str] = []
    end, before = -1, ""
    for m in sqltext.TOKEN.finditer(sql):
        t = m.group()
        c = t[0]
        if c in "[`":
            bare = t[1:-1].lower()
            if len(t) < 3 or bare not in names:
                return None
            t = bare
        elif c in "'\"":
            if len(t) < 2 or t[-1] != c:
                return None
        elif t.isascii() and (c.isalpha() or c == "_"):
            t = t.lower()
        elif not (t.isascii() and re.fullmatch(r"\d+(\.\d+)?|[(),.*=<>;+]|<=|>=|<>|!=|==|-", t)):
            return None
        wordy = c.isalnum() or c in "_[`'\""
        if end == m.start() and (wordy and before in "w" or c in "<>=!-+*" and before in tuple("<>=!-+*") and not (c == "-" and before in "<>=")):
            return None
        if before == "." and t[0].isdigit() or c == "." and out and out[-1][0].isdigit():
            return None
        out.append(t)
        end, before = m.end(), "w" if wordy else t[-1]
    while out and out[-1] == ";":
        out.pop()
    return tuple(out)


class Instances:
    """The instances of a database for a block of texts.

    Instances of one schema are shown one after the other in one staged database:
    only its rows change, never its schema, so SQLite compiles a text once for
    all of them, to the program that it would make for each, as no statistics
    take part. Queries over one table of forms that RowSets follows are answered for all
    instances at once. What the stage does not settle alike (other kinds of
    texts, schemas that differ, runs near the step budget or beyond the
    deadline) runs on a connection to the instance's own image.
    """

    def __init__(self, images: list[bytes]):
        self.images = images
        self.own: dict[int, sqlite3.Connection] = {}
        self.reader = self.writer = self.sets = None
        self.names: frozenset[str] = frozenset()
        self.tokens: dict[str, tuple[str, ...] | None] = {}
        self.answers: dict[str, Found | None] = {}
        self.refused: dict[str, Run | None] = {}
        self.ticks, self.until, self.late, self.limits, self.shown = 0, 0.0, False, Limits(), -1
        if images and max(map(len, images)) <= STAGED:
            self.stage()

    def __len__(self) -> int:
        return len(self.images)

    def close(self) -> None:
        for c in (*self.own.values(), self.reader, self.writer):
            if c:
                c.close()

    def con(self, k: int) -> sqlite3.Connection:
        """A connection to an instance's own image."""
        if k not in self.own:
            self.own[k] = open_image(self.images[k])
        return self.own[k]

    def stage(self) -> None:
        """Build the staged database and the rows of all instances, if all have the same plain tables."""
        schema = "SELECT type, name, tbl_name, sql FROM {}sqlite_master ORDER BY rowid"
        at = f"file:/staged-{os.getpid()}-{next(NAMES)}?vfs=memdb"
        writer = sqlite3.connect(at, uri=True, isolation_level=None)
        writer.execute("ATTACH ':memory:' AS src")
        writer.deserialize(self.images[0], name="src")
        own = writer.execute(schema.format("src.")).fetchall()
        ddl = [sql for kind, *_, sql in own if sql]
        plain = all(kind in ("table", "index") and not name.lower().startswith("sqlite_stat") for kind, name, *_ in own)
        if not plain or any(re.search(r"without|virtual|generated|autoincrement|references|collate|check|conflict|\bas\b|\bon\b.*\bwhere\b", x, re.I | re.S) for x in ddl) or writer.execute("PRAGMA src.encoding").fetchone()[0] != "UTF-8":
            writer.close()
            return
        tables = [name for kind, name, *_ in own if kind == "table"]
        quote = lambda x: '"' + x.replace('"', '""') + '"'
        text = lambda x: "'" + x.replace("'", "''") + "'"
        columns = {t: [(r[1], r[2]) for r in writer.execute(f"PRAGMA src.table_info({quote(t)})")] for t in tables}
        named = {c.lower() for t in tables for c, _ in columns[t]} | {t.lower() for t in tables}
        for x in ddl:
            writer.execute(x)
        writer.text_factory = lambda b: b.decode("utf-8", "replace")
        parts: dict[str, list] = {t: [] for t in tables}
        for image in self.images:
            writer.deserialize(image, name="src")
            if writer.execute(schema.format("src.")).fetchall() != own:
                writer.close()
                return
            for t in tables:
                parts[t].append(writer.execute(f"SELECT * FROM src.{quote(t)} ORDER BY rowid").fetchall())
        # A column named rowid hides the row's number.
        rowid = {"rowid"} & named
        self.moves = [] if rowid else [(f"DELETE FROM main.{quote(t)}", f"INSERT INTO main.{quote(t)} (rowid, {', '.join(quote(c) for c, _ in columns[t])}) SELECT rowid, * FROM src.{quote(t)} ORDER BY rowid") for t in tables]
        if not self.moves:
            writer.close()
            return
        self.writer = writer
        self.names = frozenset(x for x in named if re.fullmatch(r"[a-z_]\w*", x) and x.isascii() and x.upper() not in KEYWORDS)
        self.reader = sqlite3.connect(at, uri=True, isolation_level=None, cached_statements=BLOCK + 64)
        self.reader.text_factory = writer.text_factory
        self.reader.execute("PRAGMA query_only = ON")
        self.reader.set_progress_handler(self.watch, TICK)
        indexed = lambda t: {c[0].lower() for (i,) in writer.execute(f"SELECT name FROM pragma_index_list({text(t)}, 'main')").fetchall() for c in writer.execute(f"SELECT coalesce(name, '') FROM pragma_index_info({text(i)}, 'main')")}
        rowids = lambda t: {r[1].lower() for r in writer.execute(f"PRAGMA main.table_info({quote(t)})") if r[5]}
        self.sets = RowSets({t.lower(): Table(columns[t], parts[t], indexed(t) | rowids(t)) for t in tables if t.lower() in self.names and sum(map(len, parts[t])) <= MOST_ROWS}, self.plan)

    def watch(self) -> int:
        self.ticks += TICK
        self.late = self.ticks > self.limits.steps - 2 * TICK or time.monotonic() > self.until
        return int(self.late)

    def start(self) -> None:
        self.ticks, self.late, self.until = 0, False, time.monotonic() + self.limits.timeout

    def show(self, k: int) -> None:
        """Put an instance's rows on the stage."""
        if self.reader is None or self.shown == k:
            return
        self.writer.deserialize(self.images[k], name="src")
        self.writer.execute("BEGIN")
        for drop, move in self.moves:
            self.writer.execute(drop)
            self.writer.execute(move)
        self.writer.execute("COMMIT")
        self.shown = k

    def form(self, text: str) -> str:
        """One text for all that SQLite reads alike."""
        ts = canonical(text, self.names) if self.reader else None
        form = text if ts is None else " ".join(ts)
        self.tokens[form] = ts
        return form

    def answer(self, text: str) -> Found | None:
        """Rows on all instances, where that takes no run."""
        ts = self.tokens.get(text) or (canonical(text, self.names) if self.reader else None)
        return None if ts is None or BEYOND_ROWS.search(text) else self.sets.found(self.sets.unquoted(ts), text)

    def column_names(self, text: str) -> tuple[str, ...]:
        cur = self.reader.execute(text)
        names = tuple([d[0] for d in cur.description])
        cur.close()
        return names

    def plan(self, text: str) -> list[str]:
        """Steps by which SQLite runs a text; none where it refuses it."""
        try:
            return [r[3] for r in self.reader.execute(f"EXPLAIN QUERY PLAN {text}")]
        except (sqlite3.Error, sqlite3.Warning, ValueError):
            return []

    def ready(self, texts: list[str], limits: Limits, named: bool = False) -> None:
        """Sort a block of texts into refused ones, those answered at once (with the names of their columns where `named`), and others."""
        self.limits = limits
        self.refused, self.answers, self.columns = {}, {}, {}
        for t in texts:
            if t not in self.refused:
                ts = self.tokens.get(t)
                # Tokens in one form are in lower case but for quoted ones, none of which is a forbidden word.
                self.refused[t] = None if ts and ts[0] == "select" and ";" not in ts and NOT_RUN_LOWER.isdisjoint(ts) else refusal(t)
                self.answers[t] = self.answer(t) if self.refused[t] is None and replace(limits, cap=min(limits.cap, CAP)) == Limits() else None
                if named and self.answers[t] is not None:
                    self.columns[t] = self.column_names(t)
        self.tokens = {}

    def run(self, k: int, text: str) -> Run:
        """A text of the block on an instance; take all texts on one before the next."""
        if refused := self.refused[text]:
            return refused
        if (known := self.answers[text]) is not None:
            rows = known.rows(k)
            return Run(rows, len(rows), columns=self.columns.get(text, ())) if rows else NOTHING
        if self.reader is None or BEYOND_ROWS.search(text):
            return run_allowed(self.con(k), text, self.limits)
        self.show(k)
        self.start()
        cur = None
        try:
            cur = self.reader.execute(text)
            rows = cur.fetchmany(self.limits.cap + 1)
            count = len(rows)
            if count > self.limits.cap:
                while more := cur.fetchmany(10_000):
                    count += len(more)
                rows = rows[: self.limits.cap]
            out = Run(rows, count, columns=tuple([d[0] for d in cur.description or ()]))
        except (sqlite3.Error, sqlite3.Warning, ValueError, OverflowError) as e:
            out = Run(error_type="sqlite_error", error=str(e)[:300])
        finally:
            if cur is not None:
                cur.close()
        return run_allowed(self.con(k), text, self.limits) if self.late else out

    def over(self, texts: list[str], limits: Limits, use: Callable[[int, int, Run], None]) -> None:
        """use(place of the text, instance, run) for every text and instance, instance by instance."""
        self.ready(texts, limits)
        left = []
        for j, t in enumerate(texts):
            if self.answers[t] is None:
                left.append(j)
            else:
                for k in range(len(self)):
                    use(j, k, self.run(k, t))
        for k in range(len(self)):
            for j in left:
                use(j, k, self.run(k, texts[j]))


NOTHING = Run([], 0)
KEYWORDS = frozenset(
    """ABORT ACTION ADD AFTER ALL ALTER ALWAYS ANALYZE AND AS ASC ATTACH AUTOINCREMENT BEFORE BEGIN BETWEEN BY CASCADE CASE CAST CHECK COLLATE COLUMN COMMIT CONFLICT CONSTRAINT CREATE CROSS CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATABASE DEFAULT DEFERRABLE DEFERRED DELETE DESC DETACH DISTINCT DO DROP EACH ELSE END ESCAPE EXCEPT EXCLUDE EXCLUSIVE EXISTS EXPLAIN FAIL FALSE FILTER FIRST FOLLOWING FOR FOREIGN FROM FULL GENERATED GLOB GROUP GROUPS HAVING IF IGNORE IMMEDIATE IN INDEX INDEXED INITIALLY INNER INSERT INSTEAD INTERSECT INTO IS ISNULL JOIN KEY LAST LEFT LIKE LIMIT MATCH MATERIALIZED NATURAL NO NOT NOTHING NOTNULL NULL NULLS OF OFFSET ON OR ORDER OTHERS OUTER OVER PARTITION PLAN PRAGMA PRECEDING PRIMARY QUERY RAISE RANGE RECURSIVE REFERENCES REGEXP REINDEX RELEASE RENAME REPLACE RESTRICT RETURNING RIGHT ROLLBACK ROW ROWS SAVEPOINT SELECT SET TABLE TEMP TEMPORARY THEN TIES TO TRANSACTION TRIGGER TRUE UNBOUNDED UNION UNIQUE UPDATE USING VACUUM VALUES VIEW VIRTUAL WHEN WHERE WINDOW WITH WITHOUT""".split()
)


def sliced(tasks: DataFrame, images: DataFrame, stored: bool = False) -> DataFrame:
    """Tasks and images in one table, partitioned by (db_id, slice), the images of a slice before its tasks.

    tasks: db_id, a (text), b (text or null), in distinct rows, and further
    columns that go with them; written first unless they are stored already.
    Only databases with tasks are sent; their number of slices comes from a
    count by database. Tasks of one b stay together, but for those with many, as
    do texts a without b that differ in blanks, letter case and brackets alone.
    """
    spark = tasks.sparkSession
    tasks = tasks if stored else written(tasks, "tasks", spark)  # it is read several times
    more = [c for c in tasks.columns if c not in ("db_id", "a", "b")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    counts = tasks.groupBy("db_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).cast("int").alias("_slices"))
    rough = F.xxhash64(F.lower(F.regexp_replace("a", r"[\s`\[\]]+", "")))
    if stored:
        keyed, place = tasks, rough
    else:
        many = tasks.where("b is not null").groupBy("db_id", F.xxhash64("b").alias("hb")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SLICE // 4).select("db_id", "hb", F.lit(True).alias("many"))
        place = F.when(F.col("hb").isNull(), rough).when(F.col("many"), F.xxhash64("a", "b")).otherwise(F.col("hb"))
        keyed = tasks.withColumn("hb", F.when(F.col("b").isNotNull(), F.xxhash64("b"))).join(F.broadcast(many), ["db_id", "hb"], "left")
    none = F.lit(None).cast("string")
    b = none if stored else F.col("b")
    t = keyed.join(counts, "db_id").select("db_id", F.pmod(place, F.col("_slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), "a", b.alias("b"), F.lit(0).alias("inst"), F.lit(None).cast("binary").alias("image"), *more)
    i = images.join(counts, "db_id").select("db_id", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"), F.lit(0).alias("kind"), none.alias("a"), none.alias("b"), "inst", "image", *[F.lit(None).cast(tasks.schema[c].dataType).alias(c) for c in more])
    return t.unionByName(i).repartition(parts, "db_id", "slice").sortWithinPartitions("db_id", "slice", "kind", "inst", *(["a"] if stored else ["b", "a"]))


def over_slices(batches: Iterator[pd.DataFrame], each, names: list[str]) -> Iterator[pd.DataFrame]:
    """Calls each(db, connections, a, b) for every task with the connections of its slice; yields its rows."""
    now: tuple | None = None
    cons: list[sqlite3.Connection] = []
    for df in batches:
        out = []
        for db, part, kind, a, b, image in zip(df.db_id, df.slice, df.kind, df.a, df.b, df.image):
            if now != (db, part):
                for c in cons:
                    c.close()
                cons, now = [], (db, part)
            if kind == 0:
                cons.append(open_image(bytes(image)))
            else:
                out.append(each(db, cons, a, b))
        yield pd.DataFrame(out, columns=names)


def over_blocks(batches: Iterator[pd.DataFrame], many: Callable[[str, Instances, list[tuple]], list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Calls many(db, instances, [(a, b), …]) for blocks of tasks of one slice; yields its rows."""
    now: tuple | None = None
    images: list[bytes] = []
    held: Instances | None = None
    block: list[tuple] = []

    def done() -> pd.DataFrame:
        nonlocal held, block
        if held is None:
            held = Instances(images)
        out, block = many(now[0], held, block), []
        return pd.DataFrame(out, columns=names)

    for df in batches:
        for db, part, kind, a, b, image in zip(df.db_id, df.slice, df.kind, df.a, df.b, df.image):
            if now != (db, part):
                if block:
                    yield done()
                if held is not None:
                    held.close()
                images, held, now = [], None, (db, part)
            if kind == 0:
                images.append(bytes(image))
            else:
                block.append((a, b))
                if len(block) == BLOCK:
                    yield done()
    if block:
        yield done()
    if held is not None:
        held.close()


class Outcomes:
    """Outcomes of texts on all instances; equal ones are kept once, and told by a number."""

    def __init__(self, inst: Instances, limits: Limits, ordered: bool = True):
        """Without `ordered`, signatures in the order of rows are left out."""
        self.inst, self.limits, self.signer, self.ordered = inst, limits, Signer(limits.cap), ordered
        self.cells: list[tuple] = []  # bag, order, flags, count, cut, kind of failure
        self.cell_of: dict[tuple, int] = {}
        self.all: list[tuple[int, ...]] = []  # cells by instance
        self.at: dict[tuple[int, ...], int] = {}

    def cell(self, r: Run) -> int:
        bag, row, flags = self.signer(r)
        return self.numbered((bag, row if self.ordered else "", flags, r.count, r.truncated(self.limits.cap), r.error_type))

    def numbered(self, c: tuple) -> int:
        if (n := self.cell_of.get(c)) is None:
            n = self.cell_of[c] = len(self.cells)
            self.cells.append(c)
        return n

    def number(self, cells: tuple[int, ...]) -> int:
        if (n := self.at.get(cells)) is None:
            n = self.at[cells] = len(self.all)
            self.all.append(cells)
        return n

    def answered(self, found: Found) -> int:
        shape = found.shape
        if (n := shape.whole.get(found.masks)) is None:
            if shape.zero is None:
                rows = shape.rows(0, 0)
                shape.zero = self.cell(Run(rows, len(rows)) if rows else NOTHING)
            if shape.bare and not all(found.masks):
                cells = [shape.zero] * len(self.inst)
            else:
                # The order of rows and equal rows of other texts matter to ordered signatures and to limits alone.
                shared = shape.printed and not shape.limited and not (self.ordered and shape.pick)
                if not shared and not shape.signed:
                    shape.signed = [{} for _ in shape.spans[0]]
                known = shape.printed.signed if shared else shape.signed
                cells = []
                for k, part in enumerate(shape.parts(found.masks)):
                    if not part:
                        c = shape.zero
                    elif (c := known[k].get(part)) is None:
                        c = known[k][part] = self.part_cell(shape, k, part)
                    cells.append(c)
            n = shape.whole[found.masks] = self.number(tuple(cells))
        return n

    def part_cell(self, shape: Shape, k: int, part) -> int:
        """The cell of some rows of an instance."""
        if (p := shape.printed) is None:
            rows = shape.rows(k, part)
            return self.cell(Run(rows, len(rows)) if rows else NOTHING)
        at = places(part, shape.spans[0][k][0])
        if shape.pick:
            at = shape.pick(at)
        if not at:
            return self.cell(NOTHING)
        flags, texts = 0, []
        for i in at:
            text, f = p.made[i] or p.row(i)
            flags |= f
            texts.append(text)
        row = digest(texts) if self.ordered or len(at) == 1 else ""
        if len(at) == 1:
            bag = row
        else:
            texts.sort()
            bag = digest(texts)
        return self.numbered((bag, row if self.ordered else "", flags, len(at), False, ""))

    def of(self, texts: list[str]) -> dict[str, tuple[int, str, float]]:
        """Number of the outcome, first message of a failure and seconds of each text."""
        out: dict[str, tuple[int, str, float]] = {}
        self.inst.ready(texts, self.limits)
        clock = time.monotonic()
        left = {}
        for t in texts:
            if (found := self.inst.answers[t]) is not None:
                n = self.answered(found)
                was, clock = clock, time.monotonic()
                out[t] = n, "", clock - was
            else:
                left[t] = [], [""], [0.0]
        for k in range(len(self.inst)):
            for t, (cells, error, seconds) in left.items():
                r = self.inst.run(k, t)
                cells.append(self.cell(r))
                error[0] = error[0] or r.error
                was, clock = clock, time.monotonic()
                seconds[0] += clock - was
        return out | {t: (self.number(tuple(cells)), error[0], seconds[0]) for t, (cells, error, seconds) in left.items()}

    def run(self, texts: list[str]) -> list[tuple[int, str, float]]:
        """As of(), for a block with repeated texts and texts of one form."""
        forms = {a: self.inst.form(a) for a in dict.fromkeys(texts)}
        found = self.of(list(dict.fromkeys(forms.values())))
        # Messages quote their text, so texts that fail are run as they are.
        failed = [a for a, f in forms.items() if a != f and found[f][1]]
        own = self.of(failed) if failed else {}
        return [own[a] if a in own else found[forms[a]] for a in texts]


def over_texts(batches: Iterator[pa.RecordBatch], kept: list[str], names: list[str], columns: Callable[[Outcomes, list[str], bool], list[pa.Array]], limits: Limits, ordered: bool) -> Iterator[pa.RecordBatch]:
    """The columns `kept` of every task with columns(outcomes, texts, whether a slice begins), block by block."""
    now: tuple | None = None
    images: list[bytes] = []
    held: Outcomes | None = None
    began = True

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        block: list[int] = []

        def done() -> pa.RecordBatch:
            nonlocal held, began, block
            held = held or Outcomes(Instances(images), limits, ordered)
            take, at = pa.array(block, pa.int32()), began
            began, block = False, []
            arrays = [col[c].take(take) for c in kept]
            return pa.RecordBatch.from_arrays(arrays + columns(held, col["a"].take(take).to_pylist(), at), names=names)

        for i, (db, part, kind) in enumerate(zip(col["db_id"].to_pylist(), col["slice"].to_pylist(), col["kind"].to_pylist())):
            if now != (db, part):
                if block:
                    yield done()
                if held is not None:
                    held.inst.close()
                images, held, began, now = [], None, True, (db, part)
            if kind == 0:
                images.append(col["image"][i].as_py())
            else:
                block.append(i)
                if len(block) == BLOCK:
                    yield done()
        if block:
            yield done()
    if held is not None:
        held.inst.close()


VECTORS = "db_id string, sql string, vector array<string>, ordered array<string>, flags array<int>, counts array<bigint>, truncated array<boolean>, error_types array<string>, error string, seconds double"
VECTOR_NAMES = [x.split()[0] for x in VECTORS.split(", ")]
CELL_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]


def by_numbers(o: Outcomes, numbers: list[int], make: Callable[[list[tuple]], list[pa.Array]]) -> list[pa.Array]:
    """Arrays that are made of the cells by instance of each outcome once, for the texts of these outcomes."""
    once = list(dict.fromkeys(numbers))
    place = {n: i for i, n in enumerate(once)}
    take = pa.array([place[n] for n in numbers], pa.int32())
    return [x.take(take) for x in make([[o.cells[c] for c in o.all[n]] for n in once])]


def execute_texts(tasks: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each distinct (db_id, sql) run on all instances of its database: one row with an entry an instance in each array.

    tasks: db_id, sql; images: db_id, inst, image. vector and ordered hold the
    signatures without and with the order of rows ('ERROR' for a failure),
    counts all rows also beyond the cap, error_types '' or the kind of failure,
    error the first message. Null texts count as empty ones; a database without
    instances gives empty arrays; null db_ids take no part; repeated tasks run
    once; an empty table gives no rows; other columns are ignored.
    """
    rows = tasks.select("db_id", F.coalesce("sql", F.lit("")).alias("a"), F.lit(None).cast("string").alias("b")).where("db_id is not null").distinct()

    def arrays(outcomes: list[list[tuple]]) -> list[pa.Array]:
        return [pa.array([[c[j] for c in cells] for cells in outcomes], pa.list_(kind)) for j, kind in enumerate(CELL_TYPES)]

    def columns(o: Outcomes, texts: list[str], _began: bool) -> list[pa.Array]:
        got = o.run(texts)
        return [*by_numbers(o, [n for n, _, _ in got], arrays), pa.array([e for _, e, _ in got], pa.string()), pa.array([t for _, _, t in got], pa.float64())]

    return sliced(rows, images).mapInArrow(lambda it: over_texts(it, ["db_id", "a"], VECTOR_NAMES, columns, limits, True), VECTORS)


# fresh: the first row of its text. sig: MD5 of the vector's signatures, joined by '|'. failed_at: the first instance that fails. vec: the
# signatures as bytes, which are in the order of the joined text; only where an outcome without failures shows first in a block.
FIGURES = "fresh boolean, sig string, is_empty boolean, is_zero boolean, runs int, failed_at int, error_type string, failures int, interrupted int, timeouts int, truncated int, vec binary"
FIGURE_TYPES = [("sig", pa.string()), ("is_empty", pa.bool_()), ("is_zero", pa.bool_()), ("runs", pa.int32()), ("failed_at", pa.int32()), ("error_type", pa.string()), ("failures", pa.int32()), ("interrupted", pa.int32()), ("timeouts", pa.int32()), ("truncated", pa.int32())]


def figures_of(cells: list[tuple]) -> tuple:
    """The figures of one outcome, from sig to truncated."""
    kinds, flags = [c[5] for c in cells], [c[2] for c in cells]
    at = next((k for k, x in enumerate(kinds) if x), None)
    return (
        hashlib.md5("|".join([c[0] for c in cells]).encode()).hexdigest(), not any(f & HAS_CELL for f in flags), any(f & HAS_NUMBER for f in flags) and not any(f & HAS_NONZERO for f in flags),
        len(cells), at, None if at is None else kinds[at], sum(map(bool, kinds)), kinds.count("query_interrupted"), kinds.count("timeout"), sum(c[4] for c in cells),
    )


def with_figures(tasks: DataFrame, images: DataFrame, kept: list[str], limits: Limits = Limits()) -> DataFrame:
    """The columns `kept` of stored tasks (db_id, sql, …) with the figures of their text's outcome (see FIGURES), in the pass that runs them.

    A text of several rows of a block runs once. Rows without a db_id take no part.
    """
    asked = [c for c in kept if c not in ("db_id", "sql")]
    rows = tasks.where("db_id is not null").select("db_id", F.coalesce("sql", F.lit("")).alias("a"), *asked)
    kind = ", ".join([f"`{c}` {tasks.schema[c].dataType.simpleString()}" for c in kept] + [FIGURES])
    names = [*kept, *[x.split()[0] for x in FIGURES.split(", ")]]
    seen: set[str] = set()

    def columns(o: Outcomes, texts: list[str], began: bool) -> list[pa.Array]:
        if began:
            seen.clear()
        fresh = []
        for t in texts:
            fresh.append(t not in seen)
            seen.add(t)
        numbers = [n for n, _, _ in o.run(texts)]

        def arrays(outcomes: list[list[tuple]]) -> list[pa.Array]:
            each = list(zip(*map(figures_of, outcomes)))
            return [pa.array(x, t) for x, (_, t) in zip(each, FIGURE_TYPES)]

        shown: set[int] = set()
        vec = []
        for n in numbers:
            cells = None if n in shown else [o.cells[c] for c in o.all[n]]
            shown.add(n)
            vec.append(None if cells is None or any(c[5] for c in cells) else bytes.fromhex("".join([c[0] for c in cells])))
        return [pa.array(fresh, pa.bool_()), *by_numbers(o, numbers, arrays), pa.array(vec, pa.binary())]

    source = ["a" if c == "sql" else c for c in kept]
    return sliced(rows, images, True).mapInArrow(lambda it: over_texts(it, source, names, columns, limits, False), kind)


def same_result(pred: Run, gold: Run, ordered: bool, cap: int) -> bool:
    """Equal under some order of columns, rows in order where `ordered` holds; cut results also need equal counts."""
    if (pred.truncated(cap) or gold.truncated(cap)) and pred.count != gold.count:
        return False
    return pred.rows == gold.rows or permutations_fit(pred.rows, gold.rows, ordered)


VERDICTS = "db_id string, pred string, gold string, correct boolean, gold_error boolean, ordered boolean, same_set boolean, gold_truncated boolean, gold_rows bigint"
VERDICT_NAMES = [x.split()[0] for x in VERDICTS.split(", ")]


def judge_texts(pairs: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each distinct (db_id, pred, gold) judged on all instances of its database.

    correct: both run and give the same result on every instance (rows in order
    where the gold text says ORDER BY); true where a database has no instances;
    false where the prediction is null. gold_error: the gold text fails on an
    instance that is reached. same_set: on the first instance both give the same
    set of rows, columns in place. Texts are compared as given: bring them to
    the official form before. Other rules as execute_texts.
    """
    rows = pairs.select("db_id", F.col("pred").alias("a"), F.coalesce("gold", F.lit("")).alias("b")).where("db_id is not null").distinct()

    def many(db, inst, tasks) -> list[tuple]:
        forms = {x: inst.form(x) for t in tasks for x in t if x is not None}
        pairs = list(dict.fromkeys((forms[a], forms[b], "order by" in b.lower()) for a, b in tasks if a is not None))
        inst.ready(list(dict.fromkeys(x for p in pairs for x in p[:2])), limits)
        found = {p: [True, False, False, False, 0] for p in pairs}  # correct, gold_error, same_set, cut, rows of the gold text
        left = pairs
        for k in range(len(inst)):
            if not left:
                break
            going, runs = [], {}
            for p in left:
                for x in p[:2]:
                    if x not in runs:
                        runs[x] = inst.run(k, x)
                (pred, gold), f = (runs[x] for x in p[:2]), found[p]
                if k == 0:
                    f[3], f[4] = gold.truncated(limits.cap), gold.count
                    f[2] = gold.ok and pred.ok and not pred.truncated(limits.cap) and set(gold.rows) == set(pred.rows)
                f[1] = not gold.ok
                if gold.ok and pred.ok and same_result(pred, gold, p[2], limits.cap):
                    going.append(p)
                else:
                    f[0] = False
            left = going
        out = []
        for a, b in tasks:
            ordered = "order by" in b.lower()
            correct, gold_error, same_set, cut, n = (False, False, False, False, 0) if a is None else found[forms[a], forms[b], ordered]
            out.append((db, a, b, correct, gold_error, ordered, same_set, cut, n))
        return out

    return sliced(rows, images).mapInPandas(lambda it: over_blocks(it, many, VERDICT_NAMES), VERDICTS)


def by_key(run: Run, keys: list[str]) -> dict[str, list]:
    """Columns of a result by key; of two of a key the last one counts."""
    return {k: [r[i] for r in run.rows] for i, k in enumerate(keys) if not run.rows or i < len(run.rows[0])}


KEYED = "db_id string, pred string, gold string, equal boolean"


def keyed_match(pairs: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each distinct (db_id, pred, gold): whether both give the same columns on the first instance, rows in order, columns matched by the canonical text of what they select.

    False where a text fails or is no query.
    """
    from . import analysis as A

    rows = pairs.select("db_id", F.col("pred").alias("a"), F.col("gold").alias("b")).where("db_id is not null and pred is not null and gold is not null").distinct()

    def keys(sql: str) -> list[str] | None:
        try:
            first, _ = A.sides(A.parse(sql))
            scope = A.Scope(first)
            return [A.text(x["e"], scope) for x in first["select"]]
        except A.ParseError:
            return None

    def each(db, cons, a, b) -> tuple:
        ka, kb = keys(a), keys(b)
        if not cons or ka is None or kb is None:
            return db, a, b, False
        x, y = run_text(cons[0], a, limits), run_text(cons[0], b, limits)
        return db, a, b, bool(x.ok and y.ok and by_key(x, ka) == by_key(y, kb))

    first = images.where("inst = 0")
    return sliced(rows, first).mapInPandas(lambda it: over_slices(it, each, ["db_id", "pred", "gold", "equal"]), KEYED)


SOFT = "db_id string, sql string, gold string, f1 double, n int"


def soft_scores(pairs: DataFrame, images: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mean soft F1 of each distinct (db_id, pred, gold) over the instances where the gold text runs, columns matched by name; a prediction that fails scores 0 there.

    Results are scored whole: each row takes a step at least, so a cap of as many rows as steps cuts none.
    """
    from quorumframe.operators.equality import soft_f1_of_bags

    from .executor import cell

    rows = pairs.select("db_id", F.col("pred").alias("a"), F.col("gold").alias("b")).where("db_id is not null and pred is not null and gold is not null").distinct()
    names = [x.split()[0] for x in SOFT.split(", ")]
    whole = replace(limits, cap=limits.steps)

    def key_of(run: Run) -> tuple:
        """What tells a result but for the order of rows."""
        made = sorted([marshal.dumps(row, 2) for row in run.rows])
        return (run.columns, *made) if len(made) <= KEPT_ROWS else (run.columns, len(made), hashlib.blake2b(b"".join(made), digest_size=16).digest())

    def many(db, inst, tasks) -> list[tuple]:
        inst.ready(list(dict.fromkeys(x for t in tasks for x in t)), whole, named=True)
        total = {t: [0.0, 0] for t in tasks}
        known: dict[tuple[int, int], float] = {}  # scores by the numbers of results; the order of rows does not matter to them
        numbers: dict[tuple, int] = {}
        uses = Counter(x for t in tasks for x in t)

        for k in range(len(inst)):
            if len(numbers) >= KEPT_RESULTS:
                known, numbers = {}, {}
            runs: dict[str, tuple] = {}
            bags: dict[str, Counter] = {}
            left = dict(uses)

            def bag(x: str) -> Counter:
                if x not in bags:
                    bags[x] = Counter([tuple([cell(v) for v in r]) for r in runs[x][0].rows])
                return bags[x]

            for t in tasks:
                for x in t:
                    if x not in runs:
                        r = inst.run(k, x)
                        runs[x] = r, numbers.setdefault(key_of(r), len(numbers)) if r.ok and r.rows else None
                (pred, pk), (gold, gk) = runs[t[0]], runs[t[1]]
                if gold.ok:
                    total[t][1] += 1
                    if not pred.ok or not pred.rows or not gold.rows:
                        total[t][0] += float(pred.ok and not pred.rows and not gold.rows)
                    else:
                        if (key := (pk, gk)) not in known:
                            known[key] = soft_f1_of_bags(bag(t[0]), bag(t[1]), list(pred.columns), list(gold.columns))
                        total[t][0] += known[key]
                for x in t:
                    left[x] -= 1
                    if not left[x]:  # rows are held no longer than they are needed
                        runs.pop(x)
                        bags.pop(x, None)
        return [(db, a, b, total[a, b][0] / total[a, b][1] if total[a, b][1] else 0.0, total[a, b][1]) for a, b in tasks]

    return sliced(rows, images).mapInPandas(lambda it: over_blocks(it, many, names), SOFT)


# Characters of a value, values of a column, rows that are looked through for them, sample rows of a table, characters of their cells.
VALUE_CHARS, COLUMN_VALUES, SCANNED, SAMPLES, CELL_CHARS = 60, 60, 20_000, 3, 32


def short(v) -> str:
    """A cell on one line, cut to CELL_CHARS characters with dots; nothing for no value."""
    text = " ".join(("" if v is None else str(v)).split())
    return text if len(text) <= CELL_CHARS else text[: CELL_CHARS - 3] + "..."


def stored_values(images: DataFrame) -> DataFrame:
    """Distinct text values of each text column of each database's first instance, and the first rows of each table.

    (db_id, tbl, col, value, place): place counts values from 1; sample rows
    have a null col and their cells as one text. At most COLUMN_VALUES values, of
    the first SCANNED in order, of VALUE_CHARS characters, and SAMPLES rows.
    """
    first = images.groupBy("db_id").agg(F.min_by("image", "inst").alias("image"))
    kind = "db_id string, tbl string, col string, value string, place int"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for db, image in zip(df.db_id, df.image):
                con = open_image(bytes(image))
                for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                    cols = [(c[1], c[2].lower()) for c in con.execute(f'PRAGMA table_info("{t}")')]
                    for k, r in enumerate(con.execute(f'SELECT * FROM "{t}" ORDER BY rowid LIMIT {SAMPLES}'), 1):
                        out.append((db, t, None, ", ".join(f"{c}={short(v)}" for (c, _), v in zip(cols, r)), k))
                    for c, typ in cols:
                        if "char" in typ or "text" in typ or "clob" in typ:
                            got = con.execute(f'SELECT DISTINCT v FROM (SELECT substr("{c}", 1, {VALUE_CHARS}) AS v FROM "{t}" WHERE "{c}" IS NOT NULL ORDER BY "{c}" LIMIT {SCANNED}) LIMIT {COLUMN_VALUES}').fetchall()
                            out += [(db, t, c, str(v[0]), k) for k, v in enumerate((x for x in got if x[0] != ""), 1)]
                con.close()
            yield pd.DataFrame(out, columns=[x.split()[0] for x in kind.split(", ")])

    return first.mapInPandas(read, kind)


RESULTS = "db_id string, sql string, inst int, ok boolean, columns array<string>, rows array<array<string>>, row_count bigint, truncated boolean, error_type string"
RESULT_NAMES = [x.split()[0] for x in RESULTS.split(", ")]


def result_rows(tasks: DataFrame, images: DataFrame, saved: int = 1000, limits: Limits = Limits()) -> DataFrame:
    """As execute_texts with a row for each text and instance: names of the columns and at most `saved` rows of typed cells."""
    from .executor import cell

    rows = tasks.select("db_id", F.coalesce("sql", F.lit("")).alias("a"), F.lit(None).cast("string").alias("b")).where("db_id is not null").distinct()

    def each(db, cons, a, _b) -> tuple:
        found = []
        for k, c in enumerate(cons):
            r = run_text(c, a, limits)
            found.append({"inst": k, "ok": r.ok, "columns": list(r.columns), "rows": [[cell(v) for v in x] for x in (r.rows or [])[:saved]], "row_count": r.count, "truncated": r.truncated(limits.cap), "error_type": r.error_type})
        return db, a, found

    kind = "inst int, ok boolean, columns array<string>, rows array<array<string>>, row_count bigint, truncated boolean, error_type string"
    inner = "array<struct<" + ", ".join(x.replace(" ", ": ", 1) for x in kind.split(", ")) + ">>"
    made = sliced(rows, images).mapInPandas(lambda it: over_slices(it, each, ["db_id", "sql", "found"]), f"db_id string, sql string, found {inner}")
    return made.select("db_id", "sql", F.explode("found").alias("r")).select("db_id", "sql", "r.*")


def image_of(tables: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """The image of a database: table -> (column definitions, rows)."""
    con = sqlite3.connect(":memory:")
    for name, (columns, rows) in tables.items():
        con.execute(f'CREATE TABLE "{name}" ({", ".join(columns)})')
        if rows:
            con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(rows[0]))})', rows)
    con.commit()
    image = con.serialize()
    con.close()
    return image


def fingerprint(images: DataFrame) -> str:
    """A name for a set of images, whatever their order: their number and the sums of two hashes."""
    h = lambda *x: F.sum(F.xxhash64("db_id", "inst", "image", *x).cast("decimal(38,0)"))
    r = images.agg(F.count(F.lit(1)).alias("n"), h().alias("a"), h(F.lit(1)).alias("b")).first()
    return f"{r.n}:{r.a}:{r.b}"


def catalog_ddl(images: DataFrame) -> DataFrame:
    """CREATE TABLE texts that the first instance of each database keeps, in order of name: (db_id, tbl, ddl)."""
    first = images.groupBy("db_id").agg(F.min_by("image", "inst").alias("image"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for db, image in zip(df.db_id, df.image):
                con = open_image(bytes(image))
                out += [(db, n, s) for n, s in con.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
                con.close()
            yield pd.DataFrame(out, columns=["db_id", "tbl", "ddl"])

    return first.mapInPandas(read, "db_id string, tbl string, ddl string")


def read_images(spark, pattern: str) -> DataFrame:
    """Instances from files named <db_id>/<name>.sqlite: (db_id, inst, image), the file of the database's own name first, the others sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(pattern)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("db_id"), F.element_at(parts, -1).alias("file"), F.col("content").alias("image"))
    own = F.col("file") != F.concat("db_id", F.lit(".sqlite"))
    places = named.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct(own.alias("o"), "file"))).alias("all"))
    at = F.transform("all", lambda x: x["file"])
    return named.join(places, "db_id").select("db_id", (F.array_position(at, F.col("file")) - 1).cast("int").alias("inst"), "image")
