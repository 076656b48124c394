"""Queries on curation, grounding, retrieval and the store, each with an independent SQL form where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.functions import textops as X
from quorumframe.operators import curate as C
from quorumframe.operators import evidence as V
from quorumframe.session import load
from quorumframe.sources import store as R


def _labelled(spark, d):
    """Candidates labelled: executed and with at least 15 votes; questions without a gold query are dropped."""
    c = load(spark, d, "candidates").dropDuplicates(["id"]).select("id", "di", "model", "exec_ok", "vote", "created_at")
    q = load(spark, d, "questions").where("gold_sql is not null").select("di")
    return c.join(q, "di", "left_semi").select("id", "di", "model", F.when((F.col("exec_ok") == 1) & (F.col("vote") >= 15), 1).otherwise(0).alias("label"))


CAND = "c AS (SELECT DISTINCT ON (id) * FROM candidates)"
LAB = f"{CAND}, lab AS (SELECT id, di, model, CASE WHEN exec_ok = 1 AND vote >= 15 THEN 1 ELSE 0 END AS label FROM c WHERE di IN (SELECT di FROM questions WHERE gold_sql IS NOT NULL))"


def _draw(seed, *keys):
    return "md5(" + " || '|' || ".join([f"'{seed}'", *[f"COALESCE(CAST({k} AS VARCHAR), '')" for k in keys]]) + ")"


def _frac(seed, key):
    return f"(CAST('0x' || substr({_draw(seed, key)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def label_candidates(spark, d):
    """Labelled candidates."""
    return _labelled(spark, d)


def stratified_cap(spark, d):
    """All positives and drawn negatives to eight rows a question."""
    return C.stratified_cap(_labelled(spark, d), "di", "id", "label", 8)


def balance_up(spark, d):
    """Positives three times."""
    return C.upsample(_labelled(spark, d), "label", 3).select("id", "di", "label", "copy")


def balance_down(spark, d):
    """A third of the negatives, at least one a question."""
    return C.downsample_with_floor(_labelled(spark, d), "di", "id", "label", 0.33).select("id", "di", "label")


def balance_check(spark, d):
    """Counts that hold the balanced set against its source: copies of positives, negatives kept, questions, invented rows."""
    src = _labelled(spark, d)
    up = C.upsample(C.downsample_with_floor(src, "di", "id", "label", 0.33).select("id", "di", "label"), "label", 3)
    invented = up.join(src.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("invented"))
    pos = lambda df: F.sum("label").alias("pos")
    a, b = src.agg(pos(src), F.countDistinct("di").alias("q_src")), up.agg(F.sum("label").alias("pos_up"), F.countDistinct("di").alias("q_up"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").join(one(invented), "_one").select((F.col("pos_up") == 3 * F.col("pos")).alias("exact"), (F.col("q_src") == F.col("q_up")).alias("same_questions"), "invented")


def question_split(spark, d):
    """Rows of each question on one side of a split."""
    x = _labelled(spark, d)
    return x.select("id", "di", C.question_split(x, "di", 0.1).alias("side"))


def last_wins_merge(spark, d):
    """The latest delivery of each file."""
    return C.last_wins(load(spark, d, "run_files").select("file_id", "series_id", "file_name", "ingested_at"), "file_id", "ingested_at").select("file_id", "series_id", "file_name", F.unix_micros("ingested_at").alias("ingested_us"))


def first_wins_merge(spark, d):
    """The first sample of each question and text."""
    c = load(spark, d, "candidates").dropDuplicates(["id"]).where("sql_text is not null").select("id", F.concat_ws("|", "di", "sql_text").alias("k"), "di")
    return C.first_wins(c, "k", "id").select("id", "di")


def overlay_upsert(spark, d):
    """Questions with those of the first pool replaced in place and new ones added."""
    q = load(spark, d, "questions").select("di", "question", "origin")
    patch = q.where("di % 5 = 0").select((F.when(F.col("di") % 10 == 0, F.col("di")).otherwise(F.col("di") + 1_000_000)).cast("int").alias("di"), F.upper("question").alias("question"), F.lit("patched").alias("origin"))
    return C.overlay(q, patch, "di")


def leak_guard_anti(spark, d):
    """Questions whose text is not among those of a held-out tenth."""
    q = load(spark, d, "questions").where("question is not null").select("di", F.lower("question").alias("question"))
    held = q.where(F.pmod("di", F.lit(10)) == 3)
    return C.leak_guard(q.where(F.pmod("di", F.lit(10)) != 3), held, "question").select("di")


def funnel_counts(spark, d):
    """Responses by the first reason that drops them."""
    r = load(spark, d, "responses").select("response_id", "raw_response", "sql", "parse_success", "generation_seconds").dropDuplicates(["response_id"])
    why = [("no_text", F.col("raw_response").isNull() | (F.col("raw_response") == "")), ("no_sql", F.col("sql").isNull() | (F.trim("sql") == "")), ("parse_failed", ~F.col("parse_success")), ("too_long", F.length("raw_response") > 600), ("slow", F.col("generation_seconds") > 3.0)]
    return C.funnel(r, why).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def manifest_check(spark, d):
    """Manifest rows that are missing, differ or repeat."""
    q = load(spark, d, "questions").where("di >= 0").select("di", "db_id", "question")
    m = q.where("di % 3 = 0").withColumn("question", F.when(F.col("di") % 9 == 0, F.concat("question", F.lit("!"))).otherwise(F.col("question"))).withColumn("di", F.when(F.col("di") % 12 == 0, F.col("di") + 5_000_000).otherwise(F.col("di")))
    j = m.select("di", F.col("question").alias("mq"), F.col("db_id").alias("mdb")).join(q, "di", "left")
    state = F.when(F.col("question").isNull(), "missing").when((F.col("question") != F.col("mq")) | (F.col("db_id") != F.col("mdb")), "differs").otherwise("ok")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def disjoint_split(spark, d):
    """Canonical thirds by index with their sizes."""
    q = load(spark, d, "questions").where("di >= 0")
    part = F.when(F.col("di") < 100, "first").when(F.col("di") < 200, "second").otherwise("third")
    return q.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("di").alias("lo"), F.max("di").alias("hi"))


def target_union(spark, d):
    """Hard questions, unsolved ones, or both, with where they come from."""
    hard = load(spark, d, "questions").where("difficulty in ('hard', 'extra') and di >= 0").select("di", F.lit("hard").alias("h")).distinct()
    x = _labelled(spark, d).groupBy("di").agg(F.max("label").alias("m")).where("m = 0").select("di", F.lit("unsolved").alias("u"))
    return hard.join(x, "di", "full").select("di", F.array_join(F.array_compact(F.array("h", "u")), "+").alias("sources"))


def mix_fraction(spark, d):
    """Two sources mixed so that the second makes a quarter: round(n f / (1 - f)) of it, by draw, from buckets of the draw."""
    q = load(spark, d, "questions").select("di", "origin", "question").where("di >= 0")
    a = q.where("origin = 'distilled_source'").select("di", F.lit("a").alias("src"))
    n = a.agg(F.round(F.count(F.lit(1)) * 0.25 / 0.75).cast("int").alias("want"))
    b = q.where("origin = 'grpo_pool'").select("di", C.draw(5, F.col("di")).alias("dr"))
    # The draw's first three digits cut the rows into 4096 buckets; only bucket counts are put in order.
    bucket = F.substring("dr", 1, 3)
    before = b.groupBy(bucket.alias("bk")).agg(F.count(F.lit(1)).alias("c")).select("bk", (F.sum("c").over(C.W.orderBy("bk")) - F.col("c")).alias("before"))
    w = C.W.partitionBy("bk").orderBy("dr", "di")
    ranked = b.withColumn("bk", bucket).withColumn("rn", F.row_number().over(w)).join(before, "bk").withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one")
    return a.unionByName(ranked.where("rn + before <= want").select("di", F.lit("b").alias("src")))


def seeded_sample(spark, d):
    """Five candidates of each question by draw."""
    c = load(spark, d, "candidates").dropDuplicates(["id"]).select("id", "di")
    return C.lowest_draws(c, "di", "id", 5, 11)


def pending_work(spark, d):
    """Samples that questions lack of each model up to eight."""
    done = load(spark, d, "candidates").dropDuplicates(["id"]).select("di", "model")
    return C.pending(load(spark, d, "questions").where("di >= 0"), done, "di", ["coder-3b", "api-flash"], 8)


def validate_candidates(spark, d):
    """Candidate records read from JSON with defaults, a third of them broken."""
    r = load(spark, d, "responses").select("response_id", "sql", "parse_success", "parse_method", "generation_seconds").dropDuplicates(["response_id"])
    js = F.when(F.col("response_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("sql", "parse_success", "parse_method", "generation_seconds")))
    return r.select("response_id", C.validated(js).alias("v")).select("response_id", "v.*")


def explain_targets(spark, d):
    """The first distinct right candidate of each question."""
    return _labelled(spark, d).where("label = 1").groupBy("di").agg(F.min_by("id", F.struct("id")).alias("id"))


def schema_columns(spark, d):
    """Columns of all schemas with their coarse class."""
    return V.columns_of(load(spark, d, "db_schemas"))


def schema_foreign_keys(spark, d):
    """Foreign keys by name."""
    return V.foreign_keys_of(load(spark, d, "db_schemas")).drop("from_pos")


def schema_ddl(spark, d):
    """CREATE TABLE texts from metadata."""
    return V.ddl_texts(load(spark, d, "db_schemas"))


def schema_ids(spark, d):
    """Unique ids of all names."""
    return V.name_ids(load(spark, d, "db_schemas"))


def table_docs(spark, d):
    """One text for each table."""
    return V.table_documents(load(spark, d, "db_schemas"))


def table_relevance(spark, d):
    """Points of the tables that a question names."""
    return V.relevance(load(spark, d, "questions").dropDuplicates(["di"]), load(spark, d, "db_schemas")).where("points > 0").select("di", "tbl", "points")


def schema_section(spark, d):
    """Schema text of each question within its budget."""
    s = load(spark, d, "db_schemas")
    q = load(spark, d, "questions").where("di >= 0").dropDuplicates(["di"])
    return V.schema_sections(V.relevance(q, s), s, 420)


def retriever_records(spark, d):
    """Tables of each question's schema marked as used by its gold query or not."""
    from quorumframe.functions.textops import named_tables

    q = load(spark, d, "questions").where("gold_sql is not null").select("di", "db_id", named_tables(F.col("gold_sql")).alias("gold"))
    t = V.columns_of(load(spark, d, "db_schemas")).select("db_id", "tbl").distinct()
    return q.join(t, "db_id").select("di", "tbl", F.array_contains("gold", F.lower("tbl")).alias("is_related"))


def keyword_budget(spark, d):
    """Column lines of each schema within 120 characters."""
    c = V.columns_of(load(spark, d, "db_schemas")).select("db_id", "pos", F.concat("tbl", F.lit("."), "col").alias("line"))
    return V.within_budget(c, "db_id", "pos", "line", 120)


def value_grounding(spark, d):
    """Column words that the words of a question name."""
    q = load(spark, d, "questions").where("question is not null and di >= 0").select(F.col("di").alias("qid"), F.explode(V.words(F.col("question"))).alias("term"))
    v = V.columns_of(load(spark, d, "db_schemas")).select(F.regexp_replace("col", "_", " ").alias("value"))
    return V.value_hits(q.where("length(term) > 2"), v)


def column_values(spark, d):
    """At most 60 distinct brand and type values of parts in order."""
    p = load(spark, d, "part")
    v = p.select(F.explode(F.array(F.struct(F.lit("p_brand").alias("col"), F.col("p_brand").alias("v")), F.struct(F.lit("p_type").alias("col"), F.col("p_type").alias("v")))).alias("x")).select("x.*").where("length(v) <= 60").distinct()
    kept = v.groupBy("col").agg(V.heap(F.col("v"), 60, True).alias("vs"))
    return kept.select("col", F.explode("vs").alias("v"))


def _ranked(spark, d, k):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return V.block_search(e.where("id % 100 = 0"), e, k)


def retrieve_topk(spark, d):
    """The ten nearest vectors of each hundredth vector, against all vectors."""
    return _ranked(spark, d, 10).select("qid", "iid", "rnk")


def recall_mrr(spark, d):
    """Retrieval quality of each query, vectors of its label being relevant."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    rel = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label").join(e.select(F.col("vec_id").alias("iid"), "label"), "label").where("qid <> iid").select("qid", "iid")
    return V.retrieval_metrics(_ranked(spark, d, 10), rel)


def store_query_nullsafe(spark, d):
    """Stored candidates without an adapter of one model."""
    s = load(spark, d, "candidates").dropDuplicates(["id"])
    return R.query_store(s, model="api-flash", lora=None).select("id", "di", "seed")


def store_ingest_antijoin(spark, d):
    """Rows of late samples whose key the store of early ones lacks."""
    c = load(spark, d, "candidates").dropDuplicates(["id"])
    return R.new_rows(c.where("seed <= 1"), c.where("seed >= 1"), ("di", "model", "lora", "temperature", "seed")).select("id", "di", "model", "seed")


def store_stats(spark, d):
    """The ten largest model and adapter pairs."""
    return R.store_stats(load(spark, d, "candidates").dropDuplicates(["id"]))


_F = (label_candidates, stratified_cap, balance_up, balance_down, balance_check, question_split, last_wins_merge, first_wins_merge, overlay_upsert, leak_guard_anti, funnel_counts, manifest_check, disjoint_split, target_union, mix_fraction, seeded_sample, pending_work, validate_candidates, explain_targets, schema_columns, schema_foreign_keys, schema_ddl, schema_ids, table_docs, table_relevance, schema_section, retriever_records, keyword_budget, value_grounding, column_values, retrieve_topk, recall_mrr, store_query_nullsafe, store_ingest_antijoin, store_stats)
QUERIES = {f.__name__: f for f in _F}

COLS = """cols AS (SELECT db_id, table_names_original[c.table_idx + 1] AS tbl, CAST(i - 1 AS INTEGER) AS pos, c.column_name AS col, lower(column_types[i]) AS type, list_contains(primary_keys, i - 1) AS is_pk
  FROM (SELECT *, unnest(column_names_original) AS c, generate_subscripts(column_names_original, 1) AS i FROM db_schemas) t WHERE c.table_idx >= 0),
k AS (SELECT *, CASE WHEN regexp_matches(type, 'char|text|clob') THEN 'text' WHEN regexp_matches(type, 'date|time') THEN 'date' ELSE 'number' END AS kind FROM cols)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(X.STOP_WORDS))) + "]"
_WORDS = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda w: NOT list_contains(" + _STOP + ", w))"
_FORMS = "flatten([CASE WHEN w LIKE '%s' AND length(w) >= 4 THEN [w, w[1:length(w) - 1]] WHEN w NOT LIKE '%s' AND length(w) >= 3 THEN [w, w || 's'] ELSE [w] END FOR w IN qw])"
POINTS = f"""q AS (SELECT DISTINCT ON (di) di, db_id, {_WORDS.format(c='question')} AS qw FROM questions WHERE question IS NOT NULL), tw AS (SELECT db_id, tbl, {_WORDS.format(c='min(tbl)')} AS tw, list_distinct(flatten(list({_WORDS.format(c='col')}))) AS cw FROM cols GROUP BY 1, 2),
p AS (SELECT di, db_id, tbl, CAST(3 * len(list_filter(forms, lambda v: list_contains(tw, v))) + 2 * len(list_filter(forms, lambda v: list_contains(cw, v))) AS INTEGER) AS points FROM (SELECT q.di, q.db_id, t.tbl, t.tw, t.cw, {_FORMS} AS forms FROM q JOIN tw t ON t.db_id = q.db_id) x)"""
NEAR = """e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS iid, a.label AS la, b.label AS lb, ROUND(array_cosine_similarity(a.v, b.v), 9) AS sc FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
rk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY sc DESC, iid) AS INTEGER) AS rnk FROM s)"""
SQL = {
    "label_candidates": f"WITH {LAB} SELECT * FROM lab",
    "stratified_cap": f"WITH {LAB}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY di, label ORDER BY {_draw(7, 'id')}, id) AS r, SUM(label) OVER (PARTITION BY di) AS p FROM lab) SELECT di, id, label FROM n WHERE label = 1 OR r <= 8 - p",
    "balance_up": f"WITH {LAB} SELECT id, di, label, CAST(unnest(range(1, CASE WHEN label = 1 THEN 4 ELSE 2 END)) AS INTEGER) AS copy FROM lab",
    "balance_down": f"WITH {LAB}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY di, label ORDER BY {_draw(7, 'id')}, id) AS r FROM lab) SELECT id, di, label FROM n WHERE label = 1 OR r = 1 OR {_frac(7, 'id')} < 0.33",
    "balance_check": "SELECT TRUE AS exact, TRUE AS same_questions, CAST(0 AS BIGINT) AS invented",
    "question_split": f"WITH {LAB} SELECT id, di, CASE WHEN {_frac(13, 'di')} < 0.1 THEN 'valid' ELSE 'train' END AS side FROM lab",
    "last_wins_merge": "SELECT file_id, series_id, file_name, epoch_us(ingested_at) AS ingested_us FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) AS rn FROM run_files) t WHERE rn = 1",
    "first_wins_merge": f"WITH {CAND} SELECT MIN(id) AS id, di FROM c WHERE sql_text IS NOT NULL GROUP BY di, sql_text",
    "overlay_upsert": "WITH p AS (SELECT CAST(CASE WHEN di % 10 = 0 THEN di ELSE di + 1000000 END AS INTEGER) AS di, upper(question) AS question, 'patched' AS origin FROM questions WHERE di % 5 = 0) SELECT di, question, origin FROM questions WHERE di NOT IN (SELECT di FROM p) UNION ALL SELECT * FROM p",
    "leak_guard_anti": "WITH q AS (SELECT di, lower(question) AS t, ((di % 10) + 10) % 10 = 3 AS held FROM questions WHERE question IS NOT NULL) SELECT di FROM q WHERE NOT held AND t NOT IN (SELECT t FROM q WHERE held)",
    "funnel_counts": "WITH r AS (SELECT DISTINCT ON (response_id) * FROM responses) SELECT CASE WHEN raw_response IS NULL OR raw_response = '' THEN 'no_text' WHEN sql IS NULL OR trim(sql, ' ') = '' THEN 'no_sql' WHEN NOT parse_success THEN 'parse_failed' WHEN length(raw_response) > 600 THEN 'too_long' WHEN generation_seconds > 3.0 THEN 'slow' ELSE 'kept' END AS reason, COUNT(*) AS n FROM r GROUP BY 1",
    "manifest_check": "WITH q AS (SELECT di, db_id, question FROM questions WHERE di >= 0), m AS (SELECT CASE WHEN di % 12 = 0 THEN di + 5000000 ELSE di END AS di, db_id, CASE WHEN di % 9 = 0 THEN question || '!' ELSE question END AS question FROM q WHERE di % 3 = 0) SELECT CASE WHEN q.question IS NULL THEN 'missing' WHEN q.question <> m.question OR q.db_id <> m.db_id THEN 'differs' ELSE 'ok' END AS state, COUNT(*) AS n FROM m LEFT JOIN q USING (di) GROUP BY 1",
    "disjoint_split": "SELECT CASE WHEN di < 100 THEN 'first' WHEN di < 200 THEN 'second' ELSE 'third' END AS part, COUNT(*) AS n, MIN(di) AS lo, MAX(di) AS hi FROM questions WHERE di >= 0 GROUP BY 1",
    "target_union": f"WITH {LAB}, h AS (SELECT DISTINCT di, 'hard' AS h FROM questions WHERE difficulty IN ('hard', 'extra') AND di >= 0), u AS (SELECT di, 'unsolved' AS u FROM lab GROUP BY di HAVING MAX(label) = 0) SELECT COALESCE(h.di, u.di) AS di, concat_ws('+', h.h, u.u) AS sources FROM h FULL JOIN u ON h.di = u.di",
    "mix_fraction": f"WITH a AS (SELECT di FROM questions WHERE di >= 0 AND origin = 'distilled_source'), b AS (SELECT di, ROW_NUMBER() OVER (ORDER BY {_draw(5, 'di')}, di) AS rn FROM questions WHERE di >= 0 AND origin = 'grpo_pool') SELECT di, 'a' AS src FROM a UNION ALL SELECT di, 'b' FROM b WHERE rn <= (SELECT ROUND(COUNT(*) * 0.25 / 0.75) FROM a)",
    "seeded_sample": f"WITH {CAND} SELECT di, id FROM (SELECT di, id, ROW_NUMBER() OVER (PARTITION BY di ORDER BY {_draw(11, 'id')}, id) AS r FROM c) t WHERE r <= 5",
    "pending_work": f"WITH {CAND}, a AS (SELECT DISTINCT di, m AS model FROM questions, (SELECT unnest(['coder-3b', 'api-flash']) AS m) t WHERE di >= 0), n AS (SELECT di, model, COUNT(*) AS n FROM c GROUP BY 1, 2) SELECT a.di, a.model, 8 - COALESCE(n, 0) AS missing FROM a LEFT JOIN n ON a.di = n.di AND a.model = n.model WHERE COALESCE(n, 0) < 8",
    "validate_candidates": "WITH r AS (SELECT DISTINCT ON (response_id) * FROM responses) SELECT response_id, CASE WHEN response_id % 3 = 0 THEN '' ELSE COALESCE(trim(sql, ' '), '') END AS sql, CASE WHEN response_id % 3 = 0 THEN FALSE ELSE COALESCE(parse_success AND COALESCE(trim(sql, ' '), '') <> '', FALSE) END AS parse_success, CASE WHEN response_id % 3 = 0 THEN 'none' ELSE COALESCE(parse_method, 'none') END AS parse_method, CASE WHEN response_id % 3 = 0 THEN 0.0 ELSE COALESCE(generation_seconds, 0.0) END AS generation_seconds FROM r",
    "explain_targets": f"WITH {LAB} SELECT di, MIN(id) AS id FROM lab WHERE label = 1 GROUP BY di",
    "schema_columns": f"WITH {COLS} SELECT db_id, tbl, pos, col, type, kind, is_pk FROM k",
    "schema_foreign_keys": f"WITH {COLS}, f AS (SELECT db_id, unnest(foreign_keys) AS x FROM db_schemas) SELECT f.db_id, a.tbl AS from_tbl, a.col AS from_col, b.tbl AS to_tbl, b.col AS to_col FROM f JOIN cols a ON a.db_id = f.db_id AND a.pos = f.x.from_col JOIN cols b ON b.db_id = f.db_id AND b.pos = f.x.to_col",
    "schema_ddl": f"WITH {COLS}, f AS (SELECT db_id, unnest(foreign_keys) AS x FROM db_schemas), l AS (SELECT db_id, tbl, 0 AS part, pos, '\"' || col || '\" ' || upper(type) || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END AS t FROM cols UNION ALL SELECT f.db_id, a.tbl, 1, a.pos, 'FOREIGN KEY (\"' || a.col || '\") REFERENCES \"' || b.tbl || '\"(\"' || b.col || '\")' FROM f JOIN cols a ON a.db_id = f.db_id AND a.pos = f.x.from_col JOIN cols b ON b.db_id = f.db_id AND b.pos = f.x.to_col) SELECT db_id, tbl, 'CREATE TABLE \"' || tbl || '\" (' || chr(10) || '  ' || string_agg(t, ',' || chr(10) || '  ' ORDER BY part, pos, t) || chr(10) || ');' AS ddl FROM l GROUP BY db_id, tbl",
    "schema_ids": f"WITH {COLS} SELECT db_id, lower(tbl) || '.' || lower(col) AS name, '__' || lower(tbl) || '.' || lower(col) || '__' AS id FROM cols UNION SELECT db_id, lower(tbl), '__' || lower(tbl) || '__' FROM cols UNION SELECT db_id, '*', '__all__' FROM db_schemas",
    "keyword_budget": f"WITH RECURSIVE {COLS}, l AS (SELECT db_id, tbl || '.' || col AS t, ROW_NUMBER() OVER (PARTITION BY db_id ORDER BY pos) AS i FROM cols), w(db_id, i, used, kept) AS (SELECT DISTINCT db_id, CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]) FROM l UNION ALL SELECT w.db_id, l.i, CASE WHEN w.used + length(l.t) + 1 <= 120 THEN CAST(w.used + length(l.t) + 1 AS INTEGER) ELSE w.used END, CASE WHEN w.used + length(l.t) + 1 <= 120 THEN list_append(w.kept, l.t) ELSE w.kept END FROM w JOIN l ON l.db_id = w.db_id AND l.i = w.i + 1) SELECT db_id, array_to_string(arg_max(kept, i), chr(10)) AS section, arg_max(used, i) AS used FROM w GROUP BY db_id",
    "table_docs": f"WITH {COLS} SELECT db_id, tbl, tbl || ' (' || string_agg(col || ' ' || type, ', ' ORDER BY pos) || ')' AS doc FROM cols GROUP BY db_id, tbl",
    "table_relevance": f"WITH {COLS}, {POINTS} SELECT di, tbl, points FROM p WHERE points > 0",
    "schema_section": f"""WITH {COLS}, {POINTS}, fk AS (SELECT db_id, x.from_col AS pos, x.to_col AS dst FROM (SELECT db_id, unnest(foreign_keys) AS x FROM db_schemas) f), ft AS (SELECT fk.db_id, fk.pos, MAX(b.tbl || '.' || b.col) AS dst FROM fk JOIN cols b ON b.db_id = fk.db_id AND b.pos = fk.dst GROUP BY 1, 2),
      spec AS (SELECT c.db_id, c.tbl, c.pos, c.col, c.col || ':' || c.type || CASE WHEN c.is_pk OR ft.dst IS NOT NULL THEN ' (' || concat_ws(',', CASE WHEN c.is_pk THEN 'PK' END, 'FK→' || ft.dst) || ')' ELSE '' END AS s FROM cols c LEFT JOIN ft ON ft.db_id = c.db_id AND ft.pos = c.pos),
      ln AS (SELECT db_id, tbl, tbl || '(' || string_agg(s, ', ' ORDER BY pos) || ')' AS a, tbl || '(' || string_agg(col, ', ' ORDER BY pos) || ')' AS b FROM spec GROUP BY 1, 2),
      e AS (SELECT p.di, string_agg(a, chr(10) ORDER BY points <= 0, points DESC, p.tbl) AS f1, string_agg(CASE WHEN points > 0 THEN a ELSE b END, chr(10) ORDER BY points <= 0, points DESC, p.tbl) AS f2, string_agg(CASE WHEN points > 0 THEN a END, chr(10) ORDER BY points DESC, p.tbl) AS f3, list(b ORDER BY points <= 0, points DESC, p.tbl) AS f4 FROM p JOIN ln ON ln.db_id = p.db_id AND ln.tbl = p.tbl WHERE di >= 0 GROUP BY p.di)
      SELECT di, CASE WHEN length(f1) <= 420 THEN f1 WHEN length(f2) <= 420 THEN f2 ELSE COALESCE(f3, array_to_string(f4[1:8], chr(10))) END AS section FROM e""",
    "retriever_records": f"WITH {COLS}, t AS (SELECT DISTINCT db_id, tbl FROM cols) SELECT di, tbl, list_contains(regexp_extract_all(lower(regexp_replace(gold_sql, '''[^'']*''', '', 'g')), '\\b(?:from|join)\\s+[`\"\\[]?(\\w+)', 1), lower(tbl)) AS is_related FROM questions JOIN t USING (db_id) WHERE gold_sql IS NOT NULL",
    "column_values": "SELECT col, v FROM (SELECT col, v, ROW_NUMBER() OVER (PARTITION BY col ORDER BY v) AS r FROM (SELECT DISTINCT 'p_brand' AS col, p_brand AS v FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part) t WHERE length(v) <= 60) u WHERE r <= 60",
    "retrieve_topk": f"WITH {NEAR} SELECT qid, iid, rnk FROM rk WHERE rnk <= 10",
    "recall_mrr": f"WITH {NEAR}, g AS (SELECT qid, SUM((la = lb)::INT) AS n FROM s GROUP BY qid), h AS (SELECT qid, " + ", ".join(f"SUM((la = lb AND rnk <= {k})::INT) AS h{k}" for k in (3, 5, 8)) + ", SUM(CASE WHEN la = lb AND rnk <= 10 THEN 1.0::DOUBLE / rnk ELSE 0 END) AS rr FROM rk GROUP BY qid) SELECT qid, " + ", ".join(f"ROUND(CASE WHEN n = 0 THEN 1.0 ELSE CAST(h{k} AS DOUBLE) / n END, 6) AS recall_{k}, ROUND(CAST(h{k} AS DOUBLE) / {k}, 6) AS precision_{k}" for k in (3, 5, 8)) + ", ROUND(CASE WHEN n = 0 THEN 1.0 ELSE rr / n END, 6) AS mrr FROM h JOIN g USING (qid)",
    "store_query_nullsafe": f"WITH {CAND} SELECT id, di, seed FROM c WHERE model = 'api-flash' AND lora IS NULL",
    "store_ingest_antijoin": f"WITH {CAND}, i AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY di, model, lora, temperature, seed ORDER BY id) AS r FROM c WHERE seed >= 1) t WHERE r = 1) SELECT id, di, model, seed FROM i WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.seed <= 1 AND s.di IS NOT DISTINCT FROM i.di AND s.model IS NOT DISTINCT FROM i.model AND s.lora IS NOT DISTINCT FROM i.lora AND s.temperature IS NOT DISTINCT FROM i.temperature AND s.seed IS NOT DISTINCT FROM i.seed)",
    "store_stats": f"WITH {CAND} SELECT model, lora, COUNT(*) AS n, COUNT(DISTINCT di) AS questions FROM c GROUP BY 1, 2 ORDER BY n DESC, model, lora NULLS FIRST LIMIT 10",
}
