"""Queries on text operators, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumframe.functions import sqltext as Q
from quorumframe.functions import textops as X
from quorumframe.session import load


def _cand(spark, d):
    return load(spark, d, "candidates").select("id", "sql_text").dropDuplicates(["id"])


def _resp(spark, d):
    return load(spark, d, "responses").select("response_id", "question", "raw_response", "sql").dropDuplicates(["response_id"])


def norm_text(spark, d):
    """Deduplication key of each query text."""
    return _cand(spark, d).select("id", X.norm_key(F.col("sql_text")).alias("key"), X.hash16(F.col("sql_text")).alias("hash16"))


def safety_gate(spark, d):
    """Which texts a read-only gate lets through; two in seven are made unsafe."""
    t = F.when(F.col("id") % 7 == 0, F.concat(F.lit("DROP TABLE x; "), F.col("sql_text"))).when(F.col("id") % 7 == 1, F.concat(F.col("sql_text"), F.lit("; DELETE FROM t"))).when(F.col("id") % 7 == 2, F.concat(F.col("sql_text"), F.lit(" -- 'DROP'"))).otherwise(F.col("sql_text"))
    return _cand(spark, d).select("id", X.is_safe_sql(t).alias("safe"))


def official_transform(spark, d):
    """Texts cleaned for an outside evaluator."""
    c = F.concat(F.lit("-- note\n"), F.col("sql_text"), F.lit(" AND y > = YEAR(CURDATE());"))
    return _cand(spark, d).where("sql_text is not null").select("id", X.official_transform(c).alias("sql"), X.export_sql(F.col("sql_text")).alias("line"))


def order_by_rules(spark, d):
    """Two rules for whether order matters."""
    t = F.when(F.col("id") % 3 == 0, F.concat(F.col("sql_text"), F.lit(" AND a = 'order by b'"))).otherwise(F.col("sql_text"))
    return _cand(spark, d).select("id", X.has_order_by(t).alias("outside_strings"), X.mentions_order_by(t).alias("anywhere"))


def fence_extract(spark, d):
    """Query of each answer by fences, with the step that found it."""
    r = F.col("raw_response")
    return _resp(spark, d).select("response_id", X.fenced_sql(r).alias("found"), X.parse_method(r).alias("method"), X.last_fence(X.after_thinking(r)).alias("last"), X.single_think(r).alias("think_ok"))


def count_keyword(spark, d):
    """Joins, tables and the tie-break quality of each text."""
    t = F.col("sql_text")
    return _cand(spark, d).select("id", X.count_joins(t).alias("joins"), F.array_join(X.named_tables(t), ",").alias("tables"), X.quality(t).alias("quality"))


def stub_guard(spark, d):
    """Whether a text names a table of its question's gold query."""
    q = load(spark, d, "questions").select("di", "db_id", "gold_sql")
    c = load(spark, d, "candidates").select("id", "di", "sql_text").dropDuplicates(["id"])
    s = load(spark, d, "db_schemas").select("db_id", F.transform("table_names_original", F.lower).alias("names"))
    j = c.join(q, "di").join(s, "db_id", "left")
    return j.select("id", X.references_tables(F.col("sql_text"), F.coalesce("gold_sql", F.lit("")), F.coalesce("names", F.array().cast("array<string>"))).alias("real"))


def token_jaccard(spark, d):
    """Token similarity of each answer's query and its question's gold query."""
    q = load(spark, d, "questions").select("di", "gold_sql")
    r = load(spark, d, "responses").select("response_id", "di", "sql").dropDuplicates(["response_id"])
    return r.join(q, "di").where("sql is not null and gold_sql is not null").select("response_id", X.token_jaccard(F.col("sql"), F.col("gold_sql")).alias("jaccard"))


def content_words(spark, d):
    """Content words of each question and plural forms of each table name."""
    q = load(spark, d, "questions")
    return q.select("di", F.array_join(F.array_sort(X.content_tokens(F.col("question"))), " ").alias("words"), X.norm_name(F.col("db_id")).alias("name"), X.estimate_tokens(F.col("question")).alias("tokens"), X.norm_value(F.col("gold_sql")).alias("value"), X.truncate(F.col("gold_sql"), 40).alias("short"))


def name_variants(spark, d):
    """Singular and plural forms of all column words."""
    w = load(spark, d, "db_schemas").select(F.explode("column_names_original.column_name").alias("c")).select(F.explode(F.split(F.lower("c"), "_")).alias("word")).where("word <> '' and word <> '*'").distinct()
    return w.select("word", F.array_join(X.token_variants(F.col("word")), ",").alias("forms"))


def text_equality(spark, d):
    """Whether each candidate is its question's gold text but for blanks and letter case."""
    q = load(spark, d, "questions").groupBy("di").agg(F.min("gold_sql").alias("gold_sql"))
    return load(spark, d, "candidates").select("id", "di", "sql_text").dropDuplicates(["id"]).join(q, "di").select("id", X.norm_equal(F.col("sql_text"), F.col("gold_sql")).alias("same"))


def normal_match(spark, d):
    """Whether each candidate is its question's gold text when only language words are brought to lower case."""
    q = load(spark, d, "questions").where("gold_sql is not null").groupBy("di").agg(F.min("gold_sql").alias("gold_sql"))
    n = Q.udf(Q.normalize_sql, T.StringType())
    return load(spark, d, "candidates").select("id", "di", "sql_text").dropDuplicates(["id"]).join(q, "di").select("id", F.coalesce(n("sql_text") == n("gold_sql"), F.lit(False)).alias("same"))


def prompt_cut(spark, d):
    """Answers cut to 40 estimated tokens with a template of five."""
    r = _resp(spark, d).where("raw_response is not null")
    return r.select("response_id", X.truncate_prompt(F.col("raw_response"), 40, overhead=5).alias("prompt"))


def join_difficulty(spark, d):
    """Difficulty of each text by its joins: none, one or two, more."""
    n = X.count_joins(F.col("sql_text"))
    return _cand(spark, d).where("sql_text is not null").select("id", F.when(n == 0, "easy").when(n <= 2, "medium").otherwise("hard").alias("difficulty"))


def schema_lines(spark, d):
    """One line for each column of the CREATE TABLE texts: table.column:type, with PK where it is declared."""
    from quorumframe.operators.evidence import ddl_texts

    lines = Q.udf(Q.ddl_to_lines, Q.TEXTS)
    return ddl_texts(load(spark, d, "db_schemas")).select("db_id", F.explode(lines("ddl")).alias("line"))


def reasoning_steps(spark, d):
    """Number of steps of each answer, and the text trimmed to 50 estimated tokens."""
    return _resp(spark, d).select("response_id", F.coalesce(F.size(X.split_steps(F.col("raw_response"))), F.lit(-1)).alias("n_steps"), X.trim_to_tokens(F.col("raw_response"), 50).alias("short"))


def corrupt_steps(spark, d):
    """Answers with a step put too early, in two variants."""
    r = _resp(spark, d).where("raw_response is not null")
    out = None
    for seed in (1, 2):
        x = r.select("response_id", F.lit(seed).alias("variant"), X.corrupt_steps(F.col("raw_response"), F.col("response_id"), seed).alias("text"))
        out = x if out is None else out.unionByName(x)
    return out


def normalize_sql(spark, d):
    """Texts with only language words in lower case, and what is left without the tail."""
    n, p = Q.udf(Q.normalize_sql, T.StringType()), Q.udf(lambda s: Q.partialize(s)[0], T.StringType())
    return _cand(spark, d).select("id", n("sql_text").alias("normal"), p("sql_text").alias("partial"))


def related_tables(spark, d):
    """Real tables of each text by a scan with depth, and whether it holds several statements."""
    t, m = Q.udf(Q.related_tables, Q.TEXTS), Q.udf(Q.is_multi_statement, T.BooleanType())
    return _cand(spark, d).where("sql_text is not null").select("id", F.array_join(t("sql_text"), ",").alias("tables"), m("sql_text").alias("multi"))


QUERIES = {f.__name__: f for f in (norm_text, safety_gate, official_transform, order_by_rules, fence_extract, count_keyword, stub_guard, token_jaccard, content_words, name_variants, text_equality, normal_match, prompt_cut, join_difficulty, schema_lines, reasoning_steps, corrupt_steps, normalize_sql, related_tables)}

CAND = "c AS (SELECT DISTINCT ON (id) id, sql_text FROM candidates)"
RESP = "r AS (SELECT DISTINCT ON (response_id) response_id, raw_response AS raw, regexp_replace(raw_response, '(?m)^\\s*--.*$', '', 'g') AS t, sql FROM responses)"
TABLES = "list_sort(list_distinct(regexp_extract_all(lower(regexp_replace({c}, '''[^'']*''', '', 'g')), '\\b(?:from|join)\\s+[`\"\\[]?(\\w+)', 1)))"
CLEAN = "regexp_replace(trim(regexp_replace(regexp_replace({c}, '{p}', ' ', '{f}'), '\\s+', ' ', 'g')), '[; ]+$', '')"
SQL = {
    "norm_text": f"WITH {CAND} SELECT id, lower(trim(regexp_replace(sql_text, '\\s+', ' ', 'g'))) AS key, substr(sha256(sql_text), 1, 16) AS hash16 FROM c",
    "safety_gate": f"""WITH {CAND}, t AS (SELECT id, upper(CASE id % 7 WHEN 0 THEN 'DROP TABLE x; ' || sql_text WHEN 1 THEN sql_text || '; DELETE FROM t' WHEN 2 THEN sql_text || ' -- ''DROP''' ELSE sql_text END) AS s FROM c)
      SELECT id, COALESCE(regexp_matches(ltrim(substr(s, 1, 50)), '^(SELECT|WITH|EXPLAIN|PRAGMA)') AND NOT regexp_matches(regexp_replace(s, '''[^'']*''', '', 'g'), '\\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|REPLACE|ATTACH|DETACH)\\b'), FALSE) AS safe FROM t""",
    "official_transform": f"""WITH {CAND}, t AS (SELECT id, sql_text, {CLEAN.format(c="'-- note' || chr(10) || sql_text || ' AND y > = YEAR(CURDATE());'", p="(?m)^\\s*--[^\\n]*$", f="g")} AS a FROM c WHERE sql_text IS NOT NULL),
      u AS (SELECT id, sql_text, regexp_replace(a, '([<>!])\\s+=', '\\1=', 'g') AS a FROM t), v AS (SELECT id, sql_text, regexp_replace(regexp_replace(a, '(''[^'']*'')|\\bdistinct\\b', '\\1', 'gi'), '  +', ' ', 'g') AS a FROM u)
      SELECT id, regexp_replace(a, 'YEAR\\s*\\(\\s*CURDATE\\s*\\(\\s*\\)\\s*\\)', '2020', 'gi') AS sql, COALESCE(NULLIF({CLEAN.format(c="sql_text", p="--[^\\n]*", f="g")}, ''), 'SELECT 1') AS line FROM v""",
    "fence_extract": f"""WITH {RESP}, x AS (SELECT response_id, raw, t, NULLIF(trim(regexp_extract(t, '(?is)```\\s*sql\\s*\\n?(.*?)```', 1), ' '), '') AS a, NULLIF(trim(regexp_extract(t, '(?s)```\\w*\\s*\\n?(.*?)```', 1), ' '), '') AS b, NULLIF(trim(regexp_extract(t, '(?is)\\b((?:select|with)\\b(?:[^;''"]|''[^'']*(?:''|\\z)|"[^"]*(?:"|\\z))*)', 1), ' '), '') AS c,
      regexp_extract_all(list_extract(string_split(raw, '</think>'), -1), '(?s)```\\w*\\s*\\n?(.*?)```', 1) AS f FROM r)
      SELECT response_id, COALESCE(a, b, c, trim(t, ' ')) AS found, CASE WHEN t IS NULL THEN NULL WHEN a IS NOT NULL THEN 'sql_fence' WHEN b IS NOT NULL THEN 'fence' WHEN c IS NOT NULL THEN 'statement' ELSE 'rest' END AS method, CASE WHEN len(f) > 0 THEN trim(f[len(f)], ' ') END AS last,
      len(string_split(raw, '<think>')) = 2 AND len(string_split(raw, '</think>')) >= 2 AND len(string_split(raw, '```')) = 3 AS think_ok FROM x""",
    "order_by_rules": f"WITH {CAND}, t AS (SELECT id, CASE WHEN id % 3 = 0 THEN sql_text || ' AND a = ''order by b''' ELSE sql_text END AS s FROM c) SELECT id, regexp_matches(regexp_replace(s, '''[^'']*''', '', 'g'), '\\border\\s+by\\b', 'i') AS outside_strings, contains(lower(s), 'order by') AS anywhere FROM t",
    "count_keyword": f"WITH {CAND} SELECT id, CAST(len(regexp_extract_all(regexp_replace(sql_text, '''[^'']*''', '', 'g'), '(?i)\\bjoin\\b')) AS INTEGER) AS joins, array_to_string({TABLES.format(c='sql_text')}, ',') AS tables, ROUND(-2.0 * len({TABLES.format(c='sql_text')}) - 0.001 * length(sql_text), 6)::DOUBLE AS quality FROM c",
    "stub_guard": f"WITH c AS (SELECT DISTINCT ON (id) id, di, sql_text FROM candidates), x AS (SELECT id, sql_text, {TABLES.format(c='sql_text')} AS p, {TABLES.format(c=chr(67) + 'OALESCE(gold_sql, ' + chr(39) * 2 + ')')} AS g, regexp_matches(COALESCE(gold_sql, ''), '(?i)^ *with') AS cte, [lower(t) FOR t IN table_names_original] AS names FROM c JOIN questions USING (di) LEFT JOIN db_schemas USING (db_id)) SELECT id, COALESCE(list_has_any(p, CASE WHEN len(g) > 0 AND NOT cte THEN g ELSE COALESCE(names, []) END), FALSE) AS real FROM x",
    "token_jaccard": """WITH r AS (SELECT DISTINCT ON (response_id) response_id, di, sql FROM responses), t AS (SELECT response_id, list_distinct(regexp_extract_all(lower(sql), '''[^'']*''|\\w+|<=|>=|!=|<>|[^\\s\\w]')) AS a, list_distinct(regexp_extract_all(lower(gold_sql), '''[^'']*''|\\w+|<=|>=|!=|<>|[^\\s\\w]')) AS b FROM r JOIN questions USING (di) WHERE sql IS NOT NULL AND gold_sql IS NOT NULL)
      SELECT response_id, ROUND(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM t""",
    "content_words": "SELECT di, array_to_string(list_sort(list_filter(regexp_extract_all(lower(question), '[a-z0-9_]+'), lambda w: NOT list_contains(["
    + ", ".join(f"'{w}'" for w in sorted(set(X.STOP_WORDS)))
    + "], w))), ' ') AS words, replace(lower(trim(db_id, ' ')), '-', '_') AS name, GREATEST(1, length(question) // 4) AS tokens, regexp_replace(lower(COALESCE(gold_sql, '')), '[^a-z0-9]', '', 'g') AS value, CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 37) || '...' END AS short FROM (SELECT *, trim(regexp_replace(COALESCE(gold_sql, ''), '\\s+', ' ', 'g'), ' ') AS s FROM questions) t",
    "name_variants": "WITH w AS (SELECT DISTINCT unnest(string_split(lower(c.column_name), '_')) AS word FROM (SELECT unnest(column_names_original) AS c FROM db_schemas) t) SELECT word, CASE WHEN word LIKE '%s' AND length(word) >= 4 THEN word || ',' || substr(word, 1, length(word) - 1) WHEN word NOT LIKE '%s' AND length(word) >= 3 THEN word || ',' || word || 's' ELSE word END AS forms FROM w WHERE word <> '' AND word <> '*'",
    "text_equality": "WITH q AS (SELECT DISTINCT ON (di) di, gold_sql FROM questions), c AS (SELECT DISTINCT ON (id) id, di, sql_text FROM candidates) SELECT id, COALESCE(lower(trim(regexp_replace(sql_text, '\\s+', ' ', 'g'), ' ')) = lower(trim(regexp_replace(gold_sql, '\\s+', ' ', 'g'), ' ')), FALSE) AS same FROM c JOIN q USING (di)",
    "prompt_cut": "SELECT DISTINCT ON (response_id) response_id, CASE WHEN greatest(1, length(raw_response) // 4) + 5 <= 40 THEN raw_response ELSE rtrim(substr(raw_response, 1, 143), ' ') END AS prompt FROM responses WHERE raw_response IS NOT NULL",
    "join_difficulty": f"WITH {CAND}, j AS (SELECT id, len(regexp_extract_all(regexp_replace(sql_text, '''[^'']*''', '', 'g'), '(?i)\\bjoin\\b')) AS n FROM c WHERE sql_text IS NOT NULL) SELECT id, CASE WHEN n = 0 THEN 'easy' WHEN n <= 2 THEN 'medium' ELSE 'hard' END AS difficulty FROM j",
    "related_tables": f"WITH {CAND} SELECT id, array_to_string({TABLES.format(c='sql_text')}, ',') AS tables, regexp_matches(regexp_replace(sql_text, '''[^'']*''', '', 'g'), ';\\s*[^\\s;]') AS multi FROM c WHERE sql_text IS NOT NULL",
    "schema_lines": "SELECT db_id, table_names_original[c.table_idx + 1] || '.' || c.column_name || ':' || upper(column_types[i]) || CASE WHEN list_contains(primary_keys, i - 1) THEN ' PK' ELSE '' END AS line FROM (SELECT *, unnest(column_names_original) AS c, generate_subscripts(column_names_original, 1) AS i FROM db_schemas) t WHERE c.table_idx >= 0",
}
