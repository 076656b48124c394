"""Guarded execution of query texts over instances of databases.

A text is checked, parsed, rewritten for Spark and run once for all instances
where it can be lifted, else once for each. Results are capped, failures are
classified, runs have a deadline, and equal texts are run once.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.functions import sqltext
from quorumframe.functions.textops import FORBIDDEN, STARTS

from .parser import ParseError, parse
from .render import INST, ORD, Unsupported, render

# Rows that are read, rows that are kept, seconds, seconds left to stop.
CAP, SAVED, TIMEOUT, GRACE, THREADS = 100_000, 1000, 30.0, 5.0, 8


class Late(RuntimeError):
    """A job that went over its deadline: timeout, or worker_hang if it did not stop when told to."""


@dataclass
class Outcome:
    """Result of one text on one instance; rows are lists of typed cells (N, I, F, S with the text)."""

    ok: bool
    rows: list[list[str]] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    error: str = ""
    error_type: str = ""
    seconds: float = 0.0
    columns: list[str] = field(default_factory=list)


def cell(v) -> str:
    """Typed cell text of a Python value; booleans are 0 and 1."""
    if v is None:
        return "N"
    if isinstance(v, (bool, int)):
        return f"I{int(v)}"
    if isinstance(v, (bytes, bytearray)):
        try:
            return "S" + bytes(v).decode("utf-8")
        except UnicodeDecodeError:
            return "S" + bytes(v).hex()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"F{float(v)!r}"
    return f"S{v}"


def is_safe(sql: str) -> bool:
    """Read-only by its start and without a forbidden word outside strings."""
    words = [t.upper() for t in sqltext.scan(sql) if not t.startswith("'")]
    return bool(words) and words[0] in STARTS and not set(words) & set(FORBIDDEN)


class Executor:
    """databases: db_id -> list of instances, each a dict of table -> DataFrame. All instances of a database have the same columns."""

    def __init__(self, spark: SparkSession, databases: dict[str, list[dict[str, DataFrame]]], cap: int = CAP, timeout: float = TIMEOUT, threads: int = THREADS, saved: int = SAVED) -> None:
        self.spark, self.cap, self.timeout, self.threads, self.saved = spark.newSession(), cap, timeout, threads, saved
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        # Rows beyond the cap are dropped in each task before an instance's rows meet.
        self.spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(2 * cap + 2))
        self.prefix = "x" + uuid.uuid4().hex[:8]
        self.sizes = {db: len(v) for db, v in databases.items()}
        self.schemas: dict[str, dict[str, dict[str, str]]] = {}
        self.cache: dict[tuple[str, str], list[Outcome]] = {}
        self.stats = {"tasks": 0, "hits": 0, "executed": 0, "lifted": 0, "failures": 0, "timeouts": 0, "hangs": 0, "truncated": 0}
        for db, insts in databases.items():
            kinds = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "boolean": "bool"}
            self.schemas[db] = {t.lower(): {c.lower(): kinds.get(k, "double" if k.startswith("decimal") else "text") for c, k in df.dtypes} for t, df in insts[0].items()}
            for t in insts[0]:
                union = None
                for k, inst in enumerate(insts):
                    df = self.adopt(inst[t].toDF(*[c.lower() for c in inst[t].columns]))
                    df.createOrReplaceTempView(self.view(db, t, k))
                    mine = df.withColumn(INST, F.lit(k))
                    union = mine if union is None else union.unionByName(mine)
                union.createOrReplaceTempView(self.view(db, t, None))
            self.spark.range(len(insts)).select(F.col("id").cast("int").alias(INST)).createOrReplaceTempView(self.view(db, "", None))

    def adopt(self, df: DataFrame) -> DataFrame:
        """The same plan in this executor's session (its settings differ from the caller's)."""
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan())
        return DataFrame(jdf, self.spark)

    def view(self, db: str, table: str, k: int | None) -> str:
        return f"{self.prefix}__{db}__{'all' if k is None else k}__{table.lower()}"

    def failed(self, n: int, kind: str, error: str) -> list[Outcome]:
        return [Outcome(False, error=error[:300], error_type=kind) for _ in range(n)]

    def collect(self, df: DataFrame) -> tuple[list, float]:
        """Rows of a job with a deadline: beyond it the job is cancelled by its tag, and left alone if it has not stopped after GRACE seconds."""
        sc = self.spark.sparkContext
        tag = f"qf-{uuid.uuid4().hex}"
        box: dict = {}

        def work() -> None:
            sc.addJobTag(tag)
            sc.setInterruptOnCancel(True)
            try:
                box["rows"] = df.collect()
            except BaseException as e:  # noqa: BLE001
                box["error"] = e

        began = time.time()
        worker = InheritableThread(target=work, daemon=True)
        worker.start()
        worker.join(self.timeout)
        if worker.is_alive():
            sc.cancelJobsWithTag(tag)
            worker.join(GRACE)
            raise Late("timeout" if not worker.is_alive() else "worker_hang")
        if "error" in box:
            raise box["error"]
        return box["rows"], time.time() - began

    def outcome(self, rows: list, columns: list[str], seconds: float, count: int | None = None) -> Outcome:
        cut = len(rows) > self.cap
        kept = [[cell(v) for v in r] for r in rows[: min(self.cap, self.saved)]]
        return Outcome(True, kept, len(rows) if count is None else count, cut, seconds=seconds, columns=columns)

    def run_text(self, sql: str, db: str) -> list[Outcome]:
        """Outcomes of one text on every instance of a database."""
        if db not in self.sizes:
            return self.failed(1, "db_not_found", db)
        n = self.sizes[db]
        if not (sql or "").strip():
            return self.failed(n, "empty_sql", "empty text")
        if not is_safe(sql):
            return self.failed(n, "safety_rejection", "only single read-only queries are run")
        if sqltext.is_multi_statement(sql):
            return self.failed(n, "multi_statement", "several statements")
        try:
            tree = parse(sql)
        except ParseError as e:
            return self.failed(n, "sqlite_error", str(e))
        schema = self.schemas[db]
        try:
            text = render(tree, schema, {t: self.view(db, t, None) for t in schema}, True, self.view(db, "", None))
            df = self.spark.sql(text)
            names = [c for c in df.columns if c not in (INST, ORD)]
            # A row beyond the cap tells that a result is cut; ORD numbers the rows of an instance.
            rows, s = self.collect(df.where(F.col(ORD) <= self.cap + 1 + (tree.get("offset") or 0)))
            by: dict[int, list] = {k: [] for k in range(n)}
            for r in rows:
                by[r[INST]].append(r)
            # Rows beyond the cap are counted by a job of their own, and only where there are any.
            over = any(len(x) > self.cap for x in by.values())
            counts = {r[INST]: r["n"] for r in self.collect(df.groupBy(INST).agg(F.count(F.lit(1)).alias("n")))[0]} if over else {}
            self.stats["lifted"] += 1
            return [self.outcome([[r[c] for c in names] for r in sorted(by[k], key=lambda r: r[ORD])], names, s / n, counts.get(k)) for k in range(n)]
        except Late as e:
            return self.failed(n, str(e), f"over {self.timeout} s")
        except (Unsupported, PySparkException):
            pass
        return [self.run_one(parse(sql), db, k) for k in range(n)]

    def run_one(self, tree: dict, db: str, k: int) -> Outcome:
        """One instance by a job of its own."""
        schema = self.schemas[db]
        try:
            df = self.spark.sql(render(tree, schema, {t: self.view(db, t, k) for t in schema}))
            rows, s = self.collect(df.limit(self.cap + 1))
            count = self.collect(df.agg(F.count(F.lit(1)).alias("n")))[0][0].n if len(rows) > self.cap else None
            return self.outcome([list(r) for r in rows], df.columns, s, count)
        except Late as e:
            return self.failed(1, str(e), f"over {self.timeout} s")[0]
        except (Unsupported, PySparkException, ParseError) as e:
            return self.failed(1, "sqlite_error", str(e))[0]
        except Exception as e:  # noqa: BLE001
            return self.failed(1, "sqlite_error", str(e))[0]

    def signed(self, df: DataFrame, by: list[str]) -> DataFrame:
        """For each instance: rows, a bag signature and a signature in order, made where the rows are.

        A signature is the number of rows and two sums of their hashes, so rows
        of any number are added up in parallel and none comes to the driver.
        """
        kinds = {"boolean": "I", "bigint": "I", "int": "I", "smallint": "I", "tinyint": "I", "double": "F", "float": "F"}
        cells = []
        for c, t in df.dtypes:
            if c not in (INST, ORD):
                kind = kinds.get(t, "F" if t.startswith("decimal") else "S")
                x = F.col(f"`{c}`")
                text = x.cast("bigint").cast("string") if kind == "I" else (x.cast("double") + 0.0).cast("string") if kind == "F" else x.cast("string")
                cells.append(F.when(x.isNull(), F.lit("N")).otherwise(F.concat(F.lit(kind), text)))
        row = F.to_json(F.array(*cells))
        place = F.col(ORD) if ORD in df.columns else F.lit(0)
        total = lambda *xs: F.sum(F.xxhash64(*xs).cast("decimal(38,0)")).cast("string")
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total(row).alias("a"), total(row, F.lit(1)).alias("b"), total(place, row).alias("o"))

    def sign_text(self, sql: str, db: str) -> list[tuple[bool, int, str, str, str]]:
        """(ok, rows, bag signature, signature in order, kind of failure) of a text on every instance; the driver sees one row an instance."""
        if db not in self.sizes:
            return [(False, 0, "ERROR", "ERROR", "db_not_found")]
        n = self.sizes[db]
        fail = lambda kind: [(False, 0, "ERROR", "ERROR", kind)] * n
        if not (sql or "").strip():
            return fail("empty_sql")
        if not is_safe(sql):
            return fail("safety_rejection")
        if sqltext.is_multi_statement(sql):
            return fail("multi_statement")
        sig = lambda r: (True, r["n"], f"{r['n']}:{r['a']}:{r['b']}", f"{r['n']}:{r['o']}", "")
        none = (True, 0, "E", "E", "")
        schema = self.schemas[db]
        try:
            text = render(parse(sql), schema, {t: self.view(db, t, None) for t in schema}, True, self.view(db, "", None))
            rows = {r[INST]: r for r in self.collect(self.signed(self.spark.sql(text), [INST]))[0]}
            self.stats["lifted"] += 1
            return [sig(rows[k]) if k in rows else none for k in range(n)]
        except ParseError:
            return fail("sqlite_error")
        except Late as e:
            return fail(str(e))
        except (Unsupported, PySparkException):
            pass
        out = []
        for k in range(n):
            try:
                (r,) = self.collect(self.signed(self.spark.sql(render(parse(sql), schema, {t: self.view(db, t, k) for t in schema})), []))[0]
                out.append(sig(r) if r["n"] else none)
            except Late as e:
                out.append((False, 0, "ERROR", "ERROR", str(e)))
            except (Unsupported, PySparkException):
                out.append((False, 0, "ERROR", "ERROR", "sqlite_error"))
        return out

    def signatures(self, tasks: list[tuple[str, str]], home: SparkSession) -> DataFrame:
        """Signatures of distinct (text, db) tasks as a table (sql_text, db_id, inst, ok, row_count, sig, ordered_sig, error_type); texts run in a pool of threads."""
        distinct = list(dict.fromkeys(tasks))
        with ThreadPoolExecutor(self.threads) as pool:
            got = list(pool.map(lambda t: self.sign_text(*t), distinct))
        rows = [(sql, db, k, *x) for (sql, db), xs in zip(distinct, got) for k, x in enumerate(xs)]
        return home.createDataFrame(rows, "sql_text string, db_id string, inst int, ok boolean, row_count bigint, sig string, ordered_sig string, error_type string")

    def run(self, tasks: list[tuple[str, str]]) -> dict[tuple[str, str], list[Outcome]]:
        """Outcomes of (text, db) tasks: distinct ones (by their normalised text) that are not cached run in a pool of threads."""
        distinct = list(dict.fromkeys(tasks))
        keys = {t: (sqltext.normalize_sql(t[0]), t[1]) for t in distinct}
        new = list({keys[t]: t for t in reversed(distinct) if keys[t] not in self.cache}.values())[::-1]
        self.stats["tasks"] += len(tasks)
        self.stats["hits"] += len(tasks) - len(new)
        self.stats["executed"] += len(new)
        with ThreadPoolExecutor(self.threads) as pool:
            for task, got in zip(new, pool.map(lambda t: self.run_text(*t), new)):
                self.cache[keys[task]] = got
                self.stats["failures"] += sum(not o.ok for o in got)
                self.stats["timeouts"] += sum(o.error_type == "timeout" for o in got)
                self.stats["hangs"] += sum(o.error_type == "worker_hang" for o in got)
                self.stats["truncated"] += sum(o.truncated for o in got)
        return {t: self.cache[keys[t]] for t in distinct}

    def outcomes(self, tasks: list[tuple[str, str]], home: SparkSession) -> DataFrame:
        """Outcomes as a table (sql_text, db_id, inst, ok, columns, rows, row_count, truncated, error_type, seconds) in the caller's session."""
        got = self.run(tasks)
        rows = [(sql, db, k, o.ok, o.columns, o.rows, o.row_count, o.truncated, o.error_type, o.seconds) for (sql, db), os in got.items() for k, o in enumerate(os)]
        return home.createDataFrame(rows, "sql_text string, db_id string, inst int, ok boolean, columns array<string>, rows array<array<string>>, row_count bigint, truncated boolean, error_type string, seconds double")
