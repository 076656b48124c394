"""Schema and value grounding, and retrieval by embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from quorumframe.functions.textops import content_tokens, token_variants

from .pool import heap

import pandas as pd


def columns_of(schemas: DataFrame) -> DataFrame:
    """One row for each real column: db_id, tbl, pos, col, type, coarse class, is_pk."""
    types = schemas.select("db_id", "table_names_original", "column_types", "primary_keys", F.posexplode("column_names_original").alias("pos", "c"))
    low = F.lower(F.element_at("column_types", F.col("pos") + 1))
    kind = F.when(low.rlike("char|text|clob"), "text").when(low.rlike("date|time"), "date").otherwise("number")
    return types.where("c.table_idx >= 0").select("db_id", F.element_at("table_names_original", F.col("c.table_idx") + 1).alias("tbl"), "pos", F.col("c.column_name").alias("col"), low.alias("type"), kind.alias("kind"), F.array_contains("primary_keys", F.col("pos")).alias("is_pk"))


def foreign_keys_of(schemas: DataFrame) -> DataFrame:
    """Foreign keys by name: two equi joins of positions with columns."""
    c = columns_of(schemas)
    fk = schemas.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", F.col("k.from_col").alias("a"), F.col("k.to_col").alias("b"))
    left = c.select("db_id", F.col("pos").alias("a"), F.col("tbl").alias("from_tbl"), F.col("col").alias("from_col"))
    right = c.select("db_id", F.col("pos").alias("b"), F.col("tbl").alias("to_tbl"), F.col("col").alias("to_col"))
    return fk.join(left, ["db_id", "a"]).join(right, ["db_id", "b"]).select("db_id", "from_tbl", "from_col", "to_tbl", "to_col", F.col("a").alias("from_pos"))


def table_documents(schemas: DataFrame) -> DataFrame:
    """A text for each table: its name and its columns with types, in their order."""
    c = columns_of(schemas)
    cols = F.array_sort(F.collect_list(F.struct("pos", F.concat("col", F.lit(" "), "type").alias("t"))))
    return c.groupBy("db_id", "tbl").agg(F.concat(F.first("tbl"), F.lit(" ("), F.array_join(F.transform(cols, lambda x: x["t"]), ", "), F.lit(")")).alias("doc"))


def ddl_texts(schemas: DataFrame) -> DataFrame:
    """CREATE TABLE text of each table from its metadata: columns in order, then foreign keys."""
    c = columns_of(schemas)
    line = F.concat(F.lit('"'), "col", F.lit('" '), F.upper("type"), F.when(F.col("is_pk"), " PRIMARY KEY").otherwise(""))
    fk = foreign_keys_of(schemas)
    links = fk.select("db_id", F.col("from_tbl").alias("tbl"), F.col("from_pos").alias("pos"), F.concat(F.lit('FOREIGN KEY ("'), "from_col", F.lit('") REFERENCES "'), "to_tbl", F.lit('"("'), "to_col", F.lit('")')).alias("t"))
    rows = c.select("db_id", "tbl", F.lit(0).alias("part"), "pos", line.alias("t")).unionByName(links.select("db_id", "tbl", F.lit(1).alias("part"), "pos", "t"))
    lines = F.array_sort(F.collect_list(F.struct("part", "pos", "t")))
    return rows.groupBy("db_id", "tbl").agg(F.concat(F.lit('CREATE TABLE "'), F.first("tbl"), F.lit('" (\n  '), F.array_join(F.transform(lines, lambda x: x["t"]), ",\n  "), F.lit("\n);")).alias("ddl"))


def name_ids(schemas: DataFrame) -> DataFrame:
    """Unique ids of names in lower case: __table.column__ of a column, __table__ of a table, __all__ of the star."""
    c = columns_of(schemas).select("db_id", F.lower("tbl").alias("t"), F.lower("col").alias("c"))
    cols = c.select("db_id", F.concat_ws(".", "t", "c").alias("name"), F.concat(F.lit("__"), "t", F.lit("."), "c", F.lit("__")).alias("id"))
    tables = c.select("db_id", F.col("t").alias("name"), F.concat(F.lit("__"), "t", F.lit("__")).alias("id"))
    star = schemas.select("db_id", F.lit("*").alias("name"), F.lit("__all__").alias("id"))
    return cols.unionByName(tables).unionByName(star).distinct()


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


# Points of a hit on a table's name, a column's name and a stored value.
TABLE_POINTS, COLUMN_POINTS, VALUE_POINTS = 3, 2, 4


def relevance(questions: DataFrame, schemas: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Points of each table of a question's schema (di, db_id, tbl, points); tables without points have 0.

    For each content word of the question, repeats included: TABLE_POINTS for
    each of its forms among the words of the table's name, COLUMN_POINTS for
    each among those of its columns' names, and VALUE_POINTS if it names a value
    that the table stores. hits: di, tbl, term.
    """
    q = questions.where("question is not null").select("di", "db_id", content_tokens(F.col("question")).alias("qw"))
    c = columns_of(schemas).groupBy("db_id", "tbl").agg(F.array_distinct(F.flatten(F.collect_list(content_tokens(F.col("col"))))).alias("cw"))
    forms = F.flatten(F.transform("qw", token_variants))
    among = lambda ws: F.size(F.filter("forms", lambda w: F.array_contains(ws, w)))
    t = q.join(c, "db_id").withColumn("forms", forms).withColumn("tw", content_tokens(F.col("tbl")))
    t = t.select("di", "db_id", "tbl", "qw", (TABLE_POINTS * among(F.col("tw")) + COLUMN_POINTS * among(F.col("cw"))).alias("points"))
    if hits is None:
        return t.select("di", "db_id", "tbl", "points")
    h = hits.groupBy("di", "tbl").agg(F.collect_set("term").alias("terms"))
    named = F.size(F.filter("qw", lambda w: F.array_contains(F.coalesce("terms", F.array().cast("array<string>")), w)))
    return t.join(h, ["di", "tbl"], "left").select("di", "db_id", "tbl", (F.col("points") + VALUE_POINTS * named).alias("points"))


# Characters of the schema section, tables that are named when none has points.
SCHEMA_CAP, FALLBACK_TABLES = 1100, 8


def schema_sections(points: DataFrame, schemas: DataFrame, cap: int = SCHEMA_CAP) -> DataFrame:
    """Schema text of each question (di, section): tables by points, those without points last.

    In full, if that fits the cap; else with bare column names for tables
    without points; else only the tables with points (the first
    FALLBACK_TABLES in bare form where there are none).
    """
    fk = foreign_keys_of(schemas).groupBy("db_id", F.col("from_tbl").alias("tbl"), F.col("from_pos").alias("pos")).agg(F.max(F.concat_ws(".", "to_tbl", "to_col")).alias("to"))
    c = columns_of(schemas).join(fk, ["db_id", "tbl", "pos"], "left")
    marks = F.array_compact(F.array(F.when(F.col("is_pk"), "PK"), F.when(F.col("to").isNotNull(), F.concat(F.lit("FK→"), "to"))))
    spec = F.concat_ws(" ", F.concat_ws(":", "col", "type"), F.when(F.size(marks) > 0, F.concat(F.lit("("), F.array_join(marks, ","), F.lit(")"))))
    line = lambda xs: F.concat("tbl", F.lit("("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", xs.alias("t")))), lambda x: x["t"]), ", "), F.lit(")"))
    lines = c.groupBy("db_id", "tbl").agg(line(spec).alias("full"), line(F.col("col")).alias("bare"))
    order = F.struct((F.col("points") <= 0).alias("z"), F.negative("points").alias("p"), "tbl", "full", "bare")
    each = points.join(lines, ["db_id", "tbl"]).groupBy("di").agg(F.array_sort(F.collect_list(order)).alias("xs"))
    text = lambda f, xs="xs": F.array_join(F.transform(xs, f), "\n")
    full = text(lambda x: x["full"])
    compact = text(lambda x: F.when(x["z"], x["bare"]).otherwise(x["full"]))
    kept = F.filter("xs", lambda x: ~x["z"])
    last = F.when(F.size(kept) > 0, text(lambda x: x["full"], kept)).otherwise(text(lambda x: x["bare"], F.slice("xs", 1, FALLBACK_TABLES)))
    return each.select("di", F.when(F.length(full) <= cap, full).when(F.length(compact) <= cap, compact).otherwise(last).alias("section"))


# Tables with sample rows, characters of that section, tables up to which all may have some, characters of all sections.
SAMPLE_TABLES, SAMPLE_CAP, SMALL_SCHEMA, EVIDENCE_CAP = 4, 600, 6, 1800


def sample_sections(points: DataFrame, samples: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """Sample rows of each question's tables (di, section): the tables of most points, their rows in order.

    Schemas of more than SMALL_SCHEMA tables give only tables with points, if
    at least two have any. A row that does not fit the cap ends its table, not
    the section. samples: db_id, tbl, place, value (the cells of a row).
    """
    ranked = points.groupBy("di", "db_id").agg(F.array_sort(F.collect_list(F.struct(F.negative("points").alias("p"), "tbl"))).alias("ts"))
    named = F.filter("ts", lambda t: t["p"] < 0)
    few = F.slice(named, 1, SAMPLE_TABLES)
    picked = F.when((F.size("ts") > SMALL_SCHEMA) & (F.size(few) >= 2), few).otherwise(F.slice("ts", 1, SAMPLE_TABLES))
    tables = ranked.select("di", "db_id", F.posexplode(picked).alias("rank", "t")).select("di", "db_id", "rank", F.col("t.tbl").alias("tbl"))
    line = F.concat("tbl", F.lit(" #"), F.col("place").cast("string"), F.lit(": "), "value")
    rows = tables.join(samples, ["db_id", "tbl"]).groupBy("di").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "tbl", line.alias("t")))).alias("xs"))
    zero = F.struct(F.lit(0).alias("used"), F.lit("").alias("over"), F.array().cast("array<string>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        n = F.length(x["t"])
        fits = a["used"] + n <= cap
        kept = F.struct((a["used"] + n + 1).alias("used"), a["over"].alias("over"), F.concat(a["kept"], F.array(x["t"])).alias("kept"))
        over = F.struct(a["used"].alias("used"), x["tbl"].alias("over"), a["kept"].alias("kept"))
        return F.when(x["tbl"] == a["over"], a).when(fits, kept).otherwise(over)

    return rows.select("di", F.array_join(F.aggregate("xs", zero, take)["kept"], "\n").alias("section"))


def assembled(sections: list[tuple[str, Column]], cap: int = EVIDENCE_CAP) -> Column:
    """Sections under their titles in order of weight: empty ones are left out, one that is too long is cut, and what follows a full text is dropped.

    A cut section leaves three characters free, so that its end can be marked.
    """
    parts, used, full = [], F.lit(0), F.lit(False)
    for title, body in sections:
        body = F.coalesce(body, F.lit(""))
        head = f"[{title}]\n"
        room = F.lit(cap) - used - len(head)
        fits = F.length(body) <= room
        kept = F.when(fits, body).otherwise(F.substring(body, F.lit(1), F.greatest(room - 3, F.lit(0))))
        there = (body != "") & ~full & (room > 0) & (fits | (room > 3))
        full = full | (body != "") & ~there
        parts.append(F.when(there, F.concat(F.lit(head), kept)))
        used = used + F.when(there, F.length(kept) + len(head)).otherwise(0)
    return F.trim(F.array_join(F.array_compact(F.array(*parts)), "\n\n"))


def within_budget(df: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Lines of each group in order that fit a budget of characters; a line too long is skipped and later ones may fit.

    Lines that are too long for the whole budget never fit and are left out
    first; all others of a group are folded in their order.
    """
    fits = df.where(F.col(text).isNotNull()).withColumn("_fits", F.length(text) + 1 <= budget)
    items = fits.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))).alias("xs"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fold = F.aggregate("xs", zero, lambda a, x: F.when(a["used"] + F.length(x["t"]) + 1 <= budget, F.struct((a["used"] + F.length(x["t"]) + 1).alias("used"), F.concat(a["kept"], F.array(x["t"])).alias("kept"))).otherwise(a))
    return items.select(group, fold.alias("f")).select(group, F.array_join("f.kept", "\n").alias("section"), F.col("f.used").alias("used"))


def ratio(a: str, b: str) -> float:
    """Similarity of two texts by matching blocks, 0 to 1."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)])


# Priorities of an exact, a contained and a similar value, and the least similarity.
EXACT, CONTAINED, SIMILAR, LEAST = 12, 11, 10, 0.88


def value_hits(terms: DataFrame, values: DataFrame, keep: int = 3) -> DataFrame:
    """Stored values that a question's terms name: (qid, term, value, priority), at most `keep` a term.

    terms: qid, term; values: value. Exact values (of the same letters and digits)
    and values with the term as a word are found by equi joins. Values of the
    same first letter that hold the term or are held by it are contained too, by
    an equi join on three characters; those of a length that the ratio allows are
    similar by the ratio, by an equi join on first letter and length.
    """
    norm = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""), F.lit("")), c)
    v = values.where("value is not null").select("value", F.lower("value").alias("lv")).distinct().withColumn("nv", norm(F.col("lv")))
    t = terms.where("term is not null").select("qid", F.lower("term").alias("term")).distinct().withColumn("nt", norm(F.col("term")))
    exact = t.join(v, t.nt == v.nv).select("qid", "term", "value", F.lit(EXACT).alias("priority"))
    parts = v.select("value", "lv", F.explode(F.split("lv", r"\s+")).alias("w")).where("w <> lv")
    inside = t.join(parts, t.term == parts.w).select("qid", "term", "value", F.lit(CONTAINED).alias("priority"))
    t, v = t.withColumn("f", F.substring("nt", 1, 1)), v.withColumn("f", F.substring("nv", 1, 1))
    # The shorter text begins with three characters that the longer one has: an equi join on those.
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(3))))).alias("g")
    asks = t.where("length(nt) >= 3 and not (nt rlike '^[0-9]{3}$')")
    in_value = asks.withColumn("g", F.substring("nt", 1, 3)).join(v.where("length(nv) >= 3").select("*", grams("nv")), ["f", "g"]).where("nt <> nv and contains(nv, nt)")
    in_term = asks.select("*", grams("nt")).join(v.where("length(nv) >= 4").withColumn("g", F.substring("nv", 1, 3)), ["f", "g"]).where("nt <> nv and contains(nt, nv)")
    pick = lambda df, p: df.select("qid", "term", "value", F.lit(p).alias("priority"))
    # 2 * matched / both lengths, and no more is matched than the shorter one has: each term meets the lengths that allow it.
    low, high = F.ceil(F.length("nt") * LEAST / (2 - LEAST) - 1e-9), F.floor(F.length("nt") * (2 - LEAST) / LEAST + 1e-9)
    sized = t.where("length(term) >= 4").select("*", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n"))
    near = sized.join(v.withColumn("n", F.length("nv")), ["f", "n"]).where("nt <> nv")
    # What is not matched is edited, so the edits that the ratio leaves room for decide most pairs before Python sees them.
    room = F.floor((F.length("nt") + F.length("nv")) * (1 - LEAST) + 1e-9).cast("int")
    near = near.where(F.levenshtein("nt", "nv") <= room)
    held = pick(in_value, CONTAINED).unionByName(pick(in_term, CONTAINED))
    similar = pick(near.where(ratio_udf("nt", "nv") >= LEAST), SIMILAR)
    best = exact.unionByName(inside).unionByName(held).unionByName(similar).groupBy("qid", "term", "value").agg(F.max("priority").alias("priority"))
    kept = best.groupBy("qid", "term").agg(heap(F.struct(F.negative("priority").alias("p"), "value"), keep, True).alias("h"))
    return kept.select("qid", "term", F.explode("h").alias("h")).select("qid", "term", "h.value", F.negative("h.p").alias("priority"))


def unit(v: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def block_search(queries: DataFrame, items: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest items by cosine of each query (qid, iid, score), never itself.

    queries and items: id, vec. The queries are a stated set, taken in blocks of
    at most `block` vectors (the bound of what is sent); each block is compared
    with all items by matrix products, and each task keeps k items a query.
    """
    import numpy as np

    spark = items.sparkSession
    found = None
    held: list[tuple[int, list[float]]] = []

    def search(rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        mat = np.array([r[1] for r in rows])
        mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, mat))

        def scan(batches):
            qids, q = shared.value
            best_s, best_i = np.full((len(qids), k), -np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
            for df in batches:
                if not len(df):
                    continue
                m = np.stack(df.vec.to_numpy()).astype(float)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(q @ m.T, 9)
                s[qids[:, None] == df.id.to_numpy()[None, :]] = -np.inf
                alls = np.concatenate([best_s, s], axis=1)
                alli = np.concatenate([best_i, np.broadcast_to(df.id.to_numpy(), s.shape)], axis=1)
                order = np.lexsort((alli, -alls), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
            ok = np.isfinite(best_s)
            yield pd.DataFrame({"qid": np.repeat(qids, k).reshape(len(qids), k)[ok], "iid": best_i[ok], "score": best_s[ok]})

        return items.where("vec is not null").select("id", "vec").mapInPandas(scan, "qid bigint, iid bigint, score double")

    for r in queries.where("vec is not null").select("id", "vec").toLocalIterator():
        held.append((r.id, r.vec))
        if len(held) == block:
            part = search(held)
            found = part if found is None else found.unionByName(part)
            held = []
    if held or found is None:
        part = search(held) if held else spark.createDataFrame([], "qid bigint, iid bigint, score double")
        found = part if found is None else found.unionByName(part)
    kept = found.groupBy("qid").agg(heap(F.struct("score", F.negative("iid").alias("n")), k).alias("h"))
    return kept.select("qid", F.posexplode("h").alias("p", "h")).select("qid", F.negative("h.n").alias("iid"), F.col("h.score").alias("score"), (F.col("p") + 1).cast("int").alias("rnk"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """recall@k, precision@k and the mean reciprocal rank averaged over relevant items, for each query.

    ranked: qid, iid, rnk; relevant: qid, iid. A query without relevant items has recall 1.
    """
    gold = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = ranked.join(relevant, ["qid", "iid"]).groupBy("qid").agg(*[F.sum((F.col("rnk") <= k).cast("int")).alias(f"h{k}") for k in ks], F.sum(1 / F.col("rnk")).alias("rr"))
    j = ranked.select("qid").distinct().join(gold, "qid", "left").join(hit, "qid", "left")
    n = F.coalesce("n_gold", F.lit(0))
    out = [F.round(F.when(n == 0, 1.0).otherwise(F.coalesce(f"h{k}", F.lit(0)) / n), 6).alias(f"recall_{k}") for k in ks]
    out += [F.round(F.coalesce(f"h{k}", F.lit(0)) / k, 6).alias(f"precision_{k}") for k in ks]
    return j.select("qid", *out, F.round(F.when(n == 0, 1.0).otherwise(F.coalesce("rr", F.lit(0.0)) / n), 6).alias("mrr"))
