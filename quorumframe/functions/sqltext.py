"""Scanners over query text that need quotes and depth: plain Python functions and their vectorised UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"'(?:[^']|'')*'?|\"[^\"]*\"?|`[^`]*`?|\[\w[^\]]*\]|\d+(?:\.\d+)?|\w+|<=|>=|<>|!=|==|\|\||--[^\n]*|[^\s\w]", re.S)
# Words of the query language that a normaliser writes in lower case.
LANGUAGE_WORDS = frozenset(
    """select distinct all from where and or not in like between is null exists join inner left right full outer cross natural on using as group order by having limit offset asc desc union intersect except with recursive case when then else end values over partition rows range preceding following unbounded current row lag lead rank row_number dense_rank ntile percent_rank cume_dist filter count sum avg min max cast coalesce ifnull nullif abs round length upper lower substr replace trim instr""".split()
)
TAIL_WORDS = ("group", "having", "order", "limit", "offset")


def scan(sql: str) -> list[str]:
    """Tokens of a query in order, comments left out."""
    return [t for t in TOKEN.findall(sql) if not t.startswith("--")]


def find_semicolon(sql: str) -> int:
    """Place of the first semicolon outside quotes, -1 if there is none."""
    for m in TOKEN.finditer(sql):
        if m.group() == ";":
            return m.start()
    return -1


def first_statement(sql: str) -> str:
    k = find_semicolon(sql)
    return (sql if k < 0 else sql[:k]).strip()


def is_multi_statement(sql: str) -> bool:
    k = find_semicolon(sql)
    return k >= 0 and bool(re.sub(r"[\s;]+", "", sql[k:]))


def normalize_sql(sql: str) -> str:
    """Blanks collapsed, closing semicolons cut, language words in lower case, no blanks inside brackets; strings stay."""
    out = ""
    tight = True
    for m in TOKEN.finditer(sql.strip().rstrip("; \n\t")):
        t = m.group()
        if t.lower() in LANGUAGE_WORDS:
            t = t.lower()
        gap = m.start() > 0 and sql.strip()[m.start() - 1].isspace()
        if out and gap and not tight and t not in (")", ","):
            out += " "
        out += t
        tight = t == "("
    return out


def partialize(sql: str) -> tuple[str, str]:
    """The query without its grouping, having, order and limit tail at depth 0, and how it was found (scan or none)."""
    depth = 0
    for m in TOKEN.finditer(sql):
        t = m.group().lower()
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth == 0 and t in TAIL_WORDS:
            return sql[: m.start()].rstrip(), "scan"
    return sql.strip(), "none"


def related_tables(sql: str) -> list[str]:
    """Real tables named after FROM, JOIN and commas of FROM at any depth; names of CTEs are not tables."""
    ts = [t.strip("`\"[]").lower() for t in scan(sql)]
    ctes = {ts[k] for k in range(len(ts) - 2) if ts[k + 1] == "as" and ts[k + 2] == "(" and (k and ts[k - 1] in ("with", "recursive", ","))} if ts[:1] == ["with"] else set()
    out: list[str] = []
    lists: list[bool] = [False]  # whether each depth is inside a FROM list
    expect = False
    for t in ts:
        if t == "(":
            lists.append(False)
            expect = False
        elif t == ")":
            if len(lists) > 1:
                lists.pop()
        elif t in ("from", "join"):
            lists[-1] = expect = True
        elif t == "," and lists[-1]:
            expect = True
        elif t in ("where", "on", "using", "select", *TAIL_WORDS):
            lists[-1] = expect = False
        elif expect:
            if re.fullmatch(r"\w+", t) and t not in ctes:
                out.append(t)
            expect = False
    return sorted(set(out))


def ddl_to_lines(ddl: str) -> list[str]:
    """One line for each column of a CREATE TABLE text: table.column:type, with PK where it is declared."""
    out: list[str] = []
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?(\w+)[`\"\]]?\s*\((.*?)\)\s*(?:;|\Z)", ddl, re.I | re.S):
        table, body = m[1], m[2]
        keys = {k.strip(" `\"[]").lower() for k in ",".join(re.findall(r"(?<!foreign )primary\s+key\s*\(([^)]*)\)?", body, re.I)).split(",")}
        for part in re.split(r",(?![^()]*\))", body):
            c = re.match(r"\s*[`\"\[]?(\w+)[`\"\]]?\s+(\w+)(.*)", part, re.S)
            if c and c[1].lower() not in ("primary", "foreign", "unique", "constraint", "check"):
                primary = c[1].lower() in keys or re.search(r"primary\s+key", c[3], re.I)
                out.append(f"{table}.{c[1]}:{c[2].upper()}" + (" PK" if primary else ""))
    return out


def udf(fn: Callable, kind: T.DataType) -> Callable:
    """Vectorised form of a text function; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


TEXTS = T.ArrayType(T.StringType())
