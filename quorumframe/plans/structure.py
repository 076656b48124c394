"""Queries on query structure and guarded execution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumframe.functions.sqltext import TEXTS, udf
from quorumframe.operators import equality as E
from quorumframe.session import load, spread
from quorumframe.sqltools import analysis as A
from quorumframe.sqltools.executor import Executor

# Texts over the star schema for execution, one for each construct.
CORPUS = (
    "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name",
    "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'",
    "SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus",
    "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY n DESC, r_name LIMIT 3",
    "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name LIKE 'a%')",
    "SELECT o_orderkey / 2 FROM orders WHERE o_orderkey < 10 ORDER BY 1",
    "SELECT max(o_totalprice), o_orderkey FROM orders",
    "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders ORDER BY 1 LIMIT 4",
    "SELECT count(*) FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "SELECT CASE WHEN o_totalprice > 1000 THEN 'x' ELSE 'y' END AS b, count(*) FROM orders GROUP BY b",
    "SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "SELECT DISTINCT o_orderpriority FROM orders",
    "DROP TABLE orders",
    "SELECT 1; SELECT 2",
    "SELECT nothing FROM orders",
    "SELECT o_orderkey FROM orders WHERE (o_orderkey = 1",
    "",
)
INSTANCES = 3


def star_instances(spark, d) -> list[dict]:
    """Instances of the star schema: the tables as they are, then with the orders whose key is divisible by 2 and by 3."""
    base = {t: load(spark, d, t) for t in ("region", "nation", "customer", "supplier", "orders")}
    return [base | {"orders": base["orders"].where(f"o_orderkey % {k + 1} = 0")} if k else base for k in range(INSTANCES)]


def exec_outcomes(spark, d):
    """Outcomes of the texts on all instances: status, rows and the bag signature."""
    ex = Executor(spark, {"star": star_instances(spark, d)})
    o = ex.outcomes([(t, "star") for t in CORPUS], spark)
    return o.select("sql_text", "inst", "ok", "row_count", "error_type", E.sig_bag(F.col("ok"), F.col("rows"), F.col("truncated")).alias("sig"))


def exec_signatures(spark, d):
    """Signatures of the texts on all instances, made where the rows are."""
    ex = Executor(spark, {"star": star_instances(spark, d)})
    return ex.signatures([(t, "star") for t in CORPUS], spark).select("sql_text", "inst", "ok", "row_count", "sig", "error_type")


def exec_adjudicate(spark, d):
    """Texts grouped by their signature vector over the instances, failing ones left out."""
    o = exec_signatures(spark, d)
    v = o.groupBy("sql_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("inst", "sig"))), lambda x: x["sig"]).alias("vector"))
    return v.where(~F.array_contains("vector", "ERROR")).groupBy("vector").agg(F.count(F.lit(1)).alias("size"), F.min("sql_text").alias("rep"))


def first_failures(spark, d):
    """The first failing instance of each text."""
    o = exec_signatures(spark, d).where("not ok")
    return o.groupBy("sql_text").agg(F.min("inst").alias("inst"), F.min_by("error_type", "inst").alias("error_type"))


def _texts(spark, d):
    return spread(load(spark, d, "candidates").select("id", "sql_text")).dropDuplicates(["id"]).where("trim(sql_text) <> ''")


FEATURES = "n_tables int, n_joins int, n_nested int, n_conds int, n_aggs int, has_group int, has_order int, has_compare int, has_date int, component1 int"


def sql_ir(spark, d):
    """Canonical text of each query's tree; null for a text that is no query."""
    def canon(s: str) -> str | None:
        try:
            return A.query_text(A.parse(s))
        except A.ParseError:
            return None

    return _texts(spark, d).select("id", udf(canon, T.StringType())("sql_text").alias("ir"))


def hardness(spark, d):
    """Class of difficulty of each query."""
    return _texts(spark, d).select("id", udf(A.hardness, T.StringType())("sql_text").alias("hardness"))


def sql_features(spark, d):
    """Counts that describe each query, and the words of its question."""
    @F.pandas_udf(FEATURES)
    def feats(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.features(x) for x in s], columns=[p.split()[0] for p in FEATURES.split(", ")])

    n = load(spark, d, "candidates").select("id", F.size(F.split(F.trim("question"), r"\s+")).alias("q_len")).dropDuplicates(["id"])
    return _texts(spark, d).select("id", feats("sql_text").alias("f")).select("id", "f.*").join(n, "id")


def atomic_ops(spark, d):
    """Atomic operations of each query."""
    return _texts(spark, d).select("id", udf(A.atomic_ops, TEXTS)("sql_text").alias("ops"))


def _pairs(spark, d):
    q = load(spark, d, "questions").where("gold_sql is not null").select("di", "gold_sql")
    return load(spark, d, "candidates").select("id", "di", "sql_text").dropDuplicates(["id"]).where("sql_text is not null").join(q, "di")


def _links(spark, d):
    """(db_id, pairs): foreign keys as pairs of table.column names."""
    from quorumframe.operators.evidence import foreign_keys_of

    side = lambda t, c: F.lower(F.concat_ws(".", t, c))
    return foreign_keys_of(load(spark, d, "db_schemas")).groupBy("db_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", side("from_tbl", "from_col"), side("to_tbl", "to_col")))).alias("pairs"))


def exact_match(spark, d):
    """Whether each candidate matches its question's gold query in all parts, linked columns being one."""
    @F.pandas_udf(T.BooleanType())
    def same(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
        held: dict = {}
        out = []
        for x, y, pairs in zip(a, b, p):
            key = tuple(pairs) if pairs is not None else ()
            if key not in held:
                held[key] = A.foreign_key_links([tuple(k.split("=")) for k in key])
            out.append(A.exact_match(x, y, held[key]))
        return pd.Series(out, dtype="object")

    q = load(spark, d, "questions").where("gold_sql is not null").select("di", "gold_sql", F.lower(F.trim("db_id")).alias("db_id"))
    c = load(spark, d, "candidates").select("id", "di", "sql_text").dropDuplicates(["id"]).where("sql_text is not null")
    j = c.join(q, "di").join(_links(spark, d), "db_id", "left").select("id", "sql_text", "gold_sql", "pairs")
    return j.select("id", same("sql_text", "gold_sql", "pairs").alias("exact"))


def atomic_jaccard(spark, d):
    """Similarity of the operations of each candidate and its gold query, and the weighted score."""
    @F.pandas_udf(T.DoubleType())
    def sim(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(A.atomic_jaccard(x, y), 6) for x, y in zip(a, b)])

    p = _pairs(spark, d).select("id", sim("sql_text", "gold_sql").alias("jaccard"))
    return p.select("id", "jaccard", E.weighted_similarity(F.lit(1.0), F.col("jaccard")).alias("weighted"))


def partial_match(spark, d):
    """Share of right parts by class of difficulty, and over all: averages over pairs where the part is there."""
    names = [f"{p}_{x}" for p in A.PARTS for x in ("acc", "rec")]

    @F.pandas_udf(", ".join(["level string", "exact double", *[f"{n} double" for n in names]]))
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            try:
                gold = A.parse(y)
            except A.ParseError:
                out.append([None] * (len(names) + 2))
                continue
            try:
                c = A.compare(A.parse(x), gold)
            except A.ParseError:
                c = {p: (0, 0, t[2]) for p, t in A.compare(gold, gold).items()}
            row: list = [A.hardness(y), float(bool(A.exact_match(x, y)))]
            for m, p, g in (c[n] for n in A.PARTS):
                row += [float(m == p == g) if p else None, float(m == p == g) if g else None]
            out.append(row)
        return pd.DataFrame(out, columns=["level", "exact", *names])

    s = _pairs(spark, d).select(score("sql_text", "gold_sql").alias("s")).select("s.*").where("level is not null")
    agg = s.rollup("level").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in ("exact", *names)])
    # f1 of a part: 1 where both accuracy and recall are 0.
    f1 = lambda a, r: F.when((F.coalesce(a, F.lit(0.0)) == 0) & (F.coalesce(r, F.lit(0.0)) == 0), 1.0).otherwise(F.round(2 * a * r / (a + r), 6))
    return agg.select(F.coalesce("level", F.lit("all")).alias("level"), "n", "exact", *names, *[f1(F.col(f"{p}_acc"), F.col(f"{p}_rec")).alias(f"{p}_f1") for p in A.PARTS])


def exec_counts(spark, d):
    """Rows that each text gives on each instance, failing ones left out."""
    return exec_signatures(spark, d).where("ok").select("sql_text", "inst", F.col("row_count").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (exec_outcomes, exec_signatures, exec_counts, exec_adjudicate, first_failures, sql_ir, hardness, sql_features, atomic_ops, exact_match, atomic_jaccard, partial_match)}
# What each text gives, run by DuckDB on the same instances; texts that fail are left out, LIKE is brought to SQLite's.
_DUCK = {
    "SELECT o_orderkey / 2 FROM orders WHERE o_orderkey < 10 ORDER BY 1": "SELECT o_orderkey // 2 FROM orders WHERE o_orderkey < 10",
    "SELECT max(o_totalprice), o_orderkey FROM orders": "SELECT max(o_totalprice), arg_max(o_orderkey, o_totalprice) FROM orders",
    "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name LIKE 'a%')": "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name ILIKE 'a%')",
}
_FAILS = ("DROP TABLE orders", "SELECT 1; SELECT 2", "SELECT nothing FROM orders", "SELECT o_orderkey FROM orders WHERE (o_orderkey = 1", "")


def _counted(k: int, text: str) -> str:
    body = _DUCK.get(text, text)
    own = f"WITH base AS (SELECT * FROM orders) SELECT * FROM (WITH orders AS (SELECT * FROM base WHERE o_orderkey % {k + 1} = 0) {body}) t"
    quoted = text.replace("'", "''")
    return f"SELECT '{quoted}' AS sql_text, CAST({k} AS INTEGER) AS inst, COUNT(*) AS n FROM ({own}) c"


SQL = {"exec_counts": " UNION ALL ".join(_counted(k, t) for t in CORPUS if t not in _FAILS for k in range(INSTANCES))}
_T = "c AS (SELECT DISTINCT ON (id) id, question, sql_text FROM candidates), t AS (SELECT id, question, regexp_replace(lower(sql_text), '''[^'']*''', '?', 'g') AS m FROM c WHERE trim(sql_text, ' ' || chr(10) || chr(9) || chr(13)) <> '')"
_SUB = "'\\(\\s*select(?:[^()]|\\([^()]*\\))*\\)'"


def _n(word: str, of: str = "o") -> str:
    return f"len(regexp_extract_all({of}, '{word}'))"


# Counts of a query by patterns over its masked text, inner queries taken out: an independent reading for the shapes that candidates have.
_COUNTS = f"""{_T}, u AS (SELECT id, question, m, regexp_replace(m, {_SUB}, '(q)', 'g') AS o, {_n("[(]\\s*select\\b", "m")} + {_n("\\b(?:union|intersect|except)\\b", "m")} AS nested FROM t),
x AS (SELECT *, regexp_extract(o, '(?s)\\bwhere\\b(.*?)(?:\\bgroup\\s+by\\b|\\border\\s+by\\b|\\blimit\\b|$)', 1) AS w, regexp_replace(regexp_extract(o, '(?s)select\\s+(?:distinct\\s+)?(.*?)\\sfrom\\b', 1), '\\([^()]*\\)', '', 'g') AS sel, regexp_extract(o, '(?s)\\bgroup\\s+by\\b(.*?)(?:\\bhaving\\b|\\border\\s+by\\b|\\blimit\\b|$)', 1) AS g FROM u),
y AS (SELECT *, CASE WHEN w = '' THEN 0 ELSE 1 + {_n("\\b(?:and|or)\\b", "w")} - {_n("\\bbetween\\b", "w")} END AS conds, {_n("\\b(?:count|sum|avg|min|max)\\s*[(]")} AS aggs, {_n("\\bjoin\\b")} AS joins,
  (w <> '')::INT + (g <> '')::INT + regexp_matches(o, '\\border\\s+by\\b')::INT + regexp_matches(o, '\\blimit\\b')::INT + {_n("\\bjoin\\b")} + {_n("\\bor\\b")} + {_n("\\blike\\b")} AS comps FROM x),
z AS (SELECT *, (aggs > 1)::INT + (len(string_split(sel, ',')) > 1)::INT + (conds > 1)::INT + (g <> '' AND len(string_split(g, ',')) > 1)::INT AS others FROM y)"""
_NAMES = "list_distinct(regexp_extract_all(m, '\\b(?:from|join)\\s+[`\"\\[]?(\\w+)', 1))"
_KINDS = (("DROP TABLE orders", "safety_rejection"), ("SELECT 1; SELECT 2", "multi_statement"), ("SELECT nothing FROM orders", "sqlite_error"), ("SELECT o_orderkey FROM orders WHERE (o_orderkey = 1", "sqlite_error"), ("", "empty_sql"))
SQL |= {
    "hardness": f"WITH {_COUNTS} SELECT id, CASE WHEN nested = 0 AND comps <= 1 AND others = 0 THEN 'easy' WHEN nested = 0 AND (others <= 2 AND comps <= 1 OR comps <= 2 AND others < 2) THEN 'medium' WHEN nested = 0 AND (others > 2 AND comps <= 2 OR comps = 3 AND others <= 2) OR nested <= 1 AND comps <= 1 AND others = 0 THEN 'hard' ELSE 'extra' END AS hardness FROM z",
    "sql_features": f"WITH {_COUNTS} SELECT id, CAST(len({_NAMES}) AS INTEGER) AS n_tables, CAST(joins AS INTEGER) AS n_joins, CAST(nested AS INTEGER) AS n_nested, CAST(conds AS INTEGER) AS n_conds, CAST({_n('\\b(?:count|sum|avg|min|max)\\s*[(]', 'm')} AS INTEGER) AS n_aggs, (g <> '')::INT AS has_group, regexp_matches(m, '\\border\\s+by\\b')::INT AS has_order, regexp_matches(regexp_replace(m, '<\\s*>', '', 'g'), '[<>]')::INT AS has_compare, CAST(0 AS INTEGER) AS has_date, CAST(comps AS INTEGER) AS component1, CAST(len(regexp_split_to_array(trim(question, ' '), '\\s+')) AS INTEGER) AS q_len FROM z",
    "first_failures": "SELECT * FROM (VALUES " + ", ".join("('" + t.replace("'", "''") + f"', CAST(0 AS INTEGER), '{k}')" for t, k in _KINDS) + ") t(sql_text, inst, error_type)",
}
