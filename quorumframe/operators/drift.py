"""Schema drift between files: tagged-union inference and a change report.

Every record is flattened to paths with a type tag. Parallel schemas of a family
are fused into one union that keeps each alternative type of a path; values are
split into typed branches beside one canonical conversion; and each alternative
that appears, each field that comes, goes or is renamed is reported at the file
that first shows it.

The report needs the order of the files of a series. Files are range-partitioned
by (series, time, file), so a series of any size is spread over partitions, and
each partition is scanned once with a state of one schema. A null value keeps the
type the field had before; where that type lies in an earlier partition it is a
symbol until the partitions' edges (two small rows a partition) are joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.session import load, spread, written

# Words of a field name that carry no meaning of their own.
GENERIC_WORDS = frozenset("n num number total count cnt rate ratio pct percent percentage name names id ids type kind value val is at time date dir path max min avg mean used seconds secs sec s ms".split())
# Words that tell how a field measures; fields of different measures are not the same.
COUNT_WORDS = frozenset("n num number count cnt total".split())
RATE_WORDS = frozenset("rate ratio pct percent percentage".split())
# Words of one meaning.
SYNONYMS = {"wall": "elapsed", "duration": "elapsed", "runtime": "elapsed", "took": "elapsed", "temp": "temperature", "cfg": "config", "lr": "learning_rate"}

CHANGES = "file_id bigint, change string, field_from string, field_to string"


def name_words(field: str) -> list[str]:
    """Words of the last part of a path: snake and camel case split, lower case, plain stems."""
    last = field.rsplit(".", 1)[-1]
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", last).lower()
    out = []
    for w in re.split(r"[^a-z0-9]+", words):
        if w and w not in GENERIC_WORDS:
            w = SYNONYMS.get(w, w)
            for end in ("ed", "s"):
                if w.endswith(end) and len(w) - len(end) >= 4 and not w.endswith("ss"):
                    w = w[: -len(end)]
                    break
        if w:
            out.append(w)
    return out


def likeness(a: str, b: str) -> float:
    """How surely two field names mean the same, 0 to 1 (0: not the same)."""
    if a.rpartition(".")[0] != b.rpartition(".")[0]:
        return 0.0
    wa, wb = name_words(a), name_words(b)
    ca, cb = {w for w in wa if w not in GENERIC_WORDS}, {w for w in wb if w not in GENERIC_WORDS}
    rate = [bool(RATE_WORDS & set(w)) for w in (wa, wb)]
    count = [bool(COUNT_WORDS & set(w)) for w in (wa, wb)]
    if rate[0] and count[1] or rate[1] and count[0] or rate[0] != rate[1] and (count[0] or count[1]):
        return 0.0
    if not ca or not cb:  # only generic words: they must be the same words
        return 1.0 if set(wa) == set(wb) else 0.0
    share = len(ca & cb) / len(ca | cb)
    return share if share >= 1 / 3 else 0.0


def tag(v) -> str:
    """Type tag of a JSON value; whole and broken numbers are one type."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "list"


def flatten(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in record.items():
        if isinstance(v, dict):
            yield from flatten(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def parse(payload) -> dict | None:
    """The record of a payload; None for a null, broken or non-object payload."""
    if not isinstance(payload, str):
        return None
    try:
        record = json.loads(payload.replace("﻿", "").strip())
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def pair_up(gone: list[str], come: list[str], fits, alike=lambda a, b: False) -> list[tuple[str, str]]:
    """Renames: the likeliest pairs of names first, of equally likely ones those whose values are alike, each name once; ties by name."""
    scored = sorted(((-s, not alike(a, b), a, b) for a in gone for b in come if (s := likeness(a, b)) > 0 and fits(a, b)))
    pairs, seen = [], set()
    for _, _, a, b in scored:
        if ("a", a) not in seen and ("b", b) not in seen:
            seen |= {("a", a), ("b", b)}
            pairs.append((a, b))
    return pairs


def value_kind(v) -> str:
    """What a value looks like, for telling renamed fields apart: the size of a number, the shape of a text; '' for no value."""
    if v is None or isinstance(v, bool):
        return str(v)[:1] if v is not None else ""
    if isinstance(v, (int, float)):
        whole = "i" if float(v).is_integer() else "f"
        return f"{whole}{len(str(abs(int(v))))}"
    if isinstance(v, list):
        return f"l{len(v)}"
    return f"{'9' if v[:1].isdigit() else 'a'}{len(v) // 4}{'/' if '/' in v else ''}"


def step(state: dict[str, str], fields: dict[str, str], file_id: int, looked: dict[str, str] | None = None, looks: dict[str, str] | None = None) -> tuple[list[tuple], dict[str, str], list[tuple]]:
    """Compare a file with the state before it; looked and looks tell what the values of the two look like.

    state: field -> type, '' for never typed, '?x' for the unknown type that x
    had before this block. Returns the sure changes, the new state and the
    conditional changes (symbol, type, file, old name, new name): a change only
    if the symbol's type turns out to be another.
    """
    changes, open_ = [], []
    gone, come = sorted(k for k in state if k not in fields), sorted(k for k in fields if k not in state)
    new = {}

    def same(a: str, b: str) -> bool:
        old, now = state[a], fields[b]
        return not old or not now or old[0] == "?" or old == now

    def alike(a: str, b: str) -> bool:
        return bool(looked and looks and looked.get(a) and looked.get(a) == looks.get(b))

    pairs = pair_up(gone, come, same, alike)
    for a, b in pairs:
        old, now = state[a], fields[b]
        if old[:1] == "?" and now:
            open_.append((old[1:], now, file_id, a, b))
        else:
            changes.append((file_id, "renamed", a, b))
        new[b] = now or old
    left, right = {a for a, _ in pairs}, {b for _, b in pairs}
    changes += [(file_id, "removed", a, "") for a in gone if a not in left]
    changes += [(file_id, "added", "", b) for b in come if b not in right]
    for k, now in fields.items():
        if k not in state:
            new.setdefault(k, now)
            continue
        old = state[k]
        if old[:1] == "?" and now:
            open_.append((old[1:], now, file_id, k, k))
        elif old and now and old != now:
            changes.append((file_id, "type_changed", k, k))
        new[k] = now or old
    return changes, new, open_


def settle(open_: list, carry: dict[str, str]) -> list[tuple]:
    """Conditional changes once the types before the block are known."""
    out = []
    for symbol, now, file_id, a, b in open_:
        old = carry.get(symbol, "")
        if a == b:
            out += [(file_id, "type_changed", a, a)] if old and old != now else []
        elif old and old != now:
            out += [(file_id, "removed", a, ""), (file_id, "added", "", b)]
        else:
            out.append((file_id, "renamed", a, b))
    return out


def parted(tagged: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """{path: "tag look"} as {path: tag} and {path: look}."""
    both = {k: x.split(" ", 1) for k, x in tagged.items()}
    return {k: x[0] for k, x in both.items()}, {k: x[1] for k, x in both.items()}


SIGNED = "series string, at bigint, file_id bigint, sig string"


def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """payload -> the JSON text of its {path: "tag look of the value"}; broken payloads are left out."""
    for df in batches:
        sigs = [None if (r := parse(p)) is None else json.dumps({k: f"{tag(v)} {value_kind(v)}" for k, v in flatten(r)}) for p in df.payload]
        yield pd.DataFrame({"series": df.series, "at": df["at"], "file_id": df.file_id, "sig": sigs}).dropna(subset=["sig"])


EDGES = CHANGES + ", series string, at bigint, head string, open string, tail string"


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition, sorted by (series, at, file_id): changes inside it and an edge row for its first and last series.

    Memory: one schema and the changes of one batch; an edge holds one schema.
    """
    now = None  # [series, at, file_id, head fields, open changes, state, looks]
    first = True

    def edge(e) -> tuple:
        return (e[2], "", "", "", e[0], e[1], json.dumps(e[3]), json.dumps(e[4]), json.dumps([e[5], e[6]]))

    last_id = None
    for df in batches:
        rows = []
        for series, at, file_id, sig in zip(df.series, df["at"], df.file_id, df.sig):
            if now is not None and now[0] == series and file_id == last_id:
                continue  # delivered twice
            tagged = json.loads(sig)
            fields, looks = parted(tagged)
            last_id = file_id
            if now is None or now[0] != series:
                if now is not None and first:
                    rows.append(edge(now))
                    first = False
                # Only the first series of the partition can go on from an earlier one.
                symbolic = now is None
                now = [series, at, file_id, tagged, [], {k: t or (f"?{k}" if symbolic else "") for k, t in fields.items()}, looks]
                continue
            changes, now[5], open_ = step(now[5], fields, file_id, now[6], looks)
            now[6] = looks
            now[4] += open_
            rows += [(*c, None, None, None, None, None) for c in changes]
        if rows:
            yield pd.DataFrame(rows, columns=COLS)
    if now is not None:
        yield pd.DataFrame([edge(now)], columns=COLS)


COLS = [x.split()[0] for x in EDGES.split(", ")]


def join_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges in order: the changes at the partitions' borders and the conditional ones."""
    series, state, looked = None, {}, {}
    for df in batches:
        rows = []
        for e in df.itertuples(index=False):
            head, open_, (tail, looks) = json.loads(e.head), json.loads(e.open), json.loads(e.tail)
            fields, own = parted(head)
            if e.series == series:
                changes, carry, _ = step(state, fields, e.file_id, looked, own)
                rows += changes
            else:
                carry = fields
            rows += settle(open_, carry)
            state = {k: (carry.get(t[1:], "") if t[:1] == "?" else t) for k, t in tail.items()}
            series, looked = e.series, looks
        yield pd.DataFrame(rows, columns=COLS[:4])


def schema_changes(files: DataFrame, spark: SparkSession, series: str = "series_id", at: str = "written_at", file_id: str = "file_id", payload: str = "payload", partitions: int | None = None) -> DataFrame:
    """Changes between consecutive files of a series: (file_id, change, field_from, field_to).

    change is added, removed, renamed or type_changed. Order: at, then file_id.
    A file delivered twice counts once; rows with a null series, time or id, and
    payloads that are null or no JSON object, take no part. A null value is no
    change and keeps the last type. An empty input gives no rows. Other columns
    of files are ignored. A rename needs the same parent, a shared meaning of
    the names and no other type; a name of unknown type (only nulls so far)
    takes over the type of the old name.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select(F.col(series).cast("string").alias("series"), F.unix_micros(F.col(at)).alias("at"), F.col(file_id).cast("bigint").alias("file_id"), F.col(payload).alias("payload"))
    rows = rows.where("series is not null and at is not null and file_id is not null and payload is not null")
    # Written, as choosing the ranges reads it once more.
    signed = written(spread(rows).mapInPandas(signatures, SIGNED), "signed", spark)
    found = written(signed.repartitionByRange(n, "series", "at", "file_id").sortWithinPartitions("series", "at", "file_id").mapInPandas(scan, EDGES), "drift", spark)
    edges = found.where("series is not null")  # at most two rows for each partition
    border = edges.repartition(1).sortWithinPartitions("series", "at", "file_id").mapInPandas(join_edges, CHANGES)
    return found.where("series is null").select("file_id", "change", "field_from", "field_to").unionByName(border)


FIELDS = "file_id bigint, path string, type string, v_string string, v_number double, v_boolean boolean, v_list string, canonical string"
PERCENT = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s*%\s*")


def canonical(v) -> str | None:
    """One text for a value whatever its type: numbers in shortest form, '76.5%' as 0.765, one-item lists as the item."""
    if isinstance(v, list):
        return canonical(v[0]) if len(v) == 1 else json.dumps(v, ensure_ascii=False)
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        if m := PERCENT.fullmatch(v):
            return f"{float(m[1]) / 100:.10g}"
        try:
            return f"{float(v):.10g}"
        except ValueError:
            return v
    return f"{v:.10g}"


def branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for file_id, payload in zip(df.file_id, df.payload):
            for path, v in flatten(parse(payload) or {}):
                t = tag(v)
                out.append((file_id, path, t or "null", v if t == "string" else None, float(v) if t == "number" else None, v if t == "boolean" else None, json.dumps(v, ensure_ascii=False) if t == "list" else None, canonical(v)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FIELDS.split(", ")]).astype({"v_boolean": "object"})


def unified_table(files: DataFrame, file_id: str = "file_id", payload: str = "payload", order: str = "ingested_at") -> DataFrame:
    """One consistent table of all files: a row for each file and path with typed branches and a canonical text.

    Deliveries of one file_id count once (the earliest). Fields that are present
    but null have type 'null'. Payloads that are null or no JSON object give no
    rows, as does an empty input.
    """
    once = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(payload).alias("payload"), F.col(order).alias("o")).where("file_id is not null").groupBy("file_id").agg(F.min_by("payload", "o").alias("payload"))
    return once.mapInPandas(branches, FIELDS)


def fused_schema(files: DataFrame, table: DataFrame, family: str = "family", file_id: str = "file_id", at: str = "written_at") -> DataFrame:
    """The union schema: for each family and path its alternative types, how many files show each, and the first that does by its time.

    A mergeable aggregate (counts and minima), so no schema is gathered in one task.
    """
    fam = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(family).alias("family"), F.col(at).alias("at")).groupBy("file_id").agg(F.min("family").alias("family"), F.min("at").alias("at"))
    return table.join(fam, "file_id").groupBy("family", "path", "type").agg(F.count(F.lit(1)).alias("n_files"), F.min_by("file_id", F.struct("at", "file_id")).alias("first_file"))


def one_name(pairs: pd.DataFrame) -> pd.DataFrame:
    """Renames of one family -> the name that each of its renamed fields has in the common table: the first name of its chain."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(zip(pairs.a, pairs.b)):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
    return pd.DataFrame({"family": pairs.family.iloc[0], "path": list(root), "field": [find(x) for x in root]})


def common_names(files: DataFrame, changes: DataFrame, table: DataFrame, family: str = "family", file_id: str = "file_id") -> DataFrame:
    """(family, path, field): the common name of each renamed path of a family.

    Two names that ever stand in one file side by side are two fields, whatever
    they are called elsewhere. What is gathered for a family are its distinct
    renames, not its files.
    """
    fam = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(family).alias("family")).groupBy("file_id").agg(F.min("family").alias("family"))
    renames = changes.where("change = 'renamed'").join(fam, "file_id").select("family", F.col("field_from").alias("a"), F.col("field_to").alias("b")).distinct()
    names = table.join(fam, "file_id").groupBy("file_id", "family").agg(F.array_sort(F.collect_set("path")).alias("paths")).select("family", "paths").distinct()
    both = renames.join(names, "family").where(F.array_contains("paths", F.col("a")) & F.array_contains("paths", F.col("b"))).select("family", "a", "b").distinct()
    return renames.join(both, ["family", "a", "b"], "left_anti").groupBy("family").applyInPandas(one_name, "family string, path string, field string")


def consistent_table(files: DataFrame, spark: SparkSession) -> DataFrame:
    """unified_table with the family and the common name of each path as field; renamed paths keep their own as path."""
    fam = files.select(F.col("file_id").cast("bigint").alias("file_id"), "family").groupBy("file_id").agg(F.min("family").alias("family"))
    table = written(unified_table(files), "branches", spark)
    names = common_names(files, schema_changes(files, spark), table)
    named = table.join(fam, "file_id").join(names, ["family", "path"], "left")
    return named.select("file_id", "family", F.coalesce("field", "path").alias("field"), *[c for c in table.columns if c != "file_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every schema change of every series."""
    return schema_changes(load(spark, d, "run_files"), spark)


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All run records as one table of typed branches, renamed fields under one name."""
    return consistent_table(load(spark, d, "run_files"), spark)


def p4_schema(spark: SparkSession, d: str) -> DataFrame:
    """Fused schema of each family with the alternative types of each path."""
    files = load(spark, d, "run_files")
    return fused_schema(files, unified_table(files))


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that come or go at each file, renames taken apart: the part of the report that SQL can follow."""
    c = schema_changes(load(spark, d, "run_files"), spark).where("change <> 'type_changed'")
    both = F.explode(F.array(F.struct(F.lit("gone").alias("way"), F.col("field_from").alias("field")), F.struct(F.lit("came").alias("way"), F.col("field_to").alias("field"))))
    return c.select("file_id", both.alias("x")).select("file_id", "x.way", "x.field").where("field <> ''")


QUERIES = {"p4_fields": p4_fields, "p4_found": p4_found, "p4_table": p4_table, "p4_schema": p4_schema}
_TREE = """f AS (SELECT CAST(file_id AS BIGINT) AS file_id, min(series_id) AS series_id, min(family) AS family, min(written_at) AS wat, arg_min(payload, ingested_at) AS payload FROM run_files GROUP BY 1),
      j AS (SELECT file_id, series_id, family, wat, trim(replace(payload, chr(65279), ''), ' ' || chr(10) || chr(13) || chr(9)) AS p FROM f),
      o AS (SELECT * FROM j WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
      t AS (SELECT file_id, series_id, family, wat, replace(substr(fullkey, 3), '"', '') AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE 'list' END AS type FROM o, json_tree(o.p) WHERE type <> 'OBJECT' AND fullkey NOT LIKE '%[%' AND fullkey <> '$')"""
SQL = {
    "p4_schema": f"WITH {_TREE} SELECT family, path, type, COUNT(*) AS n_files, arg_min(file_id, {{'a': wat, 'f': file_id}}) AS first_file FROM t GROUP BY 1, 2, 3",
    "p4_fields": f"""WITH {_TREE}, l AS (SELECT file_id, LAG(file_id) OVER (PARTITION BY series_id ORDER BY wat, file_id) AS before FROM o)
      SELECT l.file_id, 'came' AS way, t.path AS field FROM l JOIN t ON t.file_id = l.file_id LEFT JOIN t q ON q.file_id = l.before AND q.path = t.path WHERE l.before IS NOT NULL AND q.path IS NULL
      UNION ALL SELECT l.file_id, 'gone', t.path FROM l JOIN t ON t.file_id = l.before LEFT JOIN t q ON q.file_id = l.file_id AND q.path = t.path WHERE q.path IS NULL""",
}
