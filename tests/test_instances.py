"""Execution on instances against plain SQLite, against the Spark executor, and the selection rules against plain Python."""

import hashlib
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quorumframe.operators import pool as P
from quorumframe.plans import executed as X
from quorumframe.sqltools import instances as I
from quorumframe.sqltools.executor import Executor


def images(spark):
    one = {"t": (["id INTEGER", "a TEXT", "b REAL"], [(1, "x", 1.0), (2, "x", 2.5), (3, None, 0.0)]), "u": (["id INTEGER", "v TEXT"], [(1, "p"), (3, "q")])}
    two = {"t": (["id INTEGER", "a TEXT", "b REAL"], []), "u": one["u"]}
    return spark.createDataFrame([("d", 0, bytearray(I.image_of(one))), ("d", 1, bytearray(I.image_of(two))), ("e", 0, bytearray(I.image_of(one)))], "db_id string, inst int, image binary")


def outcomes(spark, texts, limits=I.Limits(), db="d"):
    tasks = spark.createDataFrame([(db, s, "more") for s in texts] * 2, "db_id string, sql string, image string")
    return {r.sql: r for r in I.execute_texts(tasks, images(spark), limits).collect()}


def test_outcomes(spark):
    loop = "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) SELECT count(*) FROM c"
    got = outcomes(spark, ["select id from t", "select id from t order by id desc", "select sum(b) from t where a = 'y'", "select 0, 'x' from u", "drop table t", "select 1; select 2", "select nothing from t", "  ", None, loop, "select count(*) from t"], I.Limits(steps=200_000))
    assert len(got) == 11
    a, b = got["select id from t"], got["select id from t order by id desc"]
    assert a.vector == b.vector and a.ordered[0] != b.ordered[0] and a.counts == [3, 0] and a.flags == [7, 0]
    assert got["select 0, 'x' from u"].flags == [I.HAS_CELL | I.HAS_NUMBER] * 2
    kinds = {k: r.error_types[0] for k, r in got.items() if r.error_types[0]}
    assert kinds["drop table t"] == "safety_rejection" and kinds["select 1; select 2"] == "multi_statement" and kinds["select nothing from t"] == "sqlite_error" and kinds[""] == "empty_sql" and kinds[loop] == "query_interrupted"
    assert got["drop table t"].vector == ["ERROR", "ERROR"] and got["select count(*) from t"].error == ""


def test_deadline_caps_and_unknown(spark):
    loop = "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) SELECT count(*) FROM c"
    assert outcomes(spark, [loop], I.Limits(steps=10**12, timeout=0.3))[loop].error_types == ["timeout"] * 2
    cut = outcomes(spark, ["select id from t"], I.Limits(cap=2))["select id from t"]
    assert cut.truncated == [True, False] and cut.counts == [3, 0]
    assert outcomes(spark, ["select 1"], db="none") == {} or outcomes(spark, ["select 1"], db="none")["select 1"].vector == []
    assert I.execute_texts(spark.createDataFrame([], "db_id string, sql string"), images(spark)).count() == 0


def test_slices_give_the_same(spark, monkeypatch):
    texts = [f"select id + {k} from t where id > {k % 4}" for k in range(60)]
    whole = {k: r.vector for k, r in outcomes(spark, texts).items()}
    monkeypatch.setattr(I, "SLICE", 7)
    assert {k: r.vector for k, r in outcomes(spark, texts).items()} == whole and len(whole) == 60


def test_judgement(spark):
    pairs = [("select a, id from t", "select id, a from t", True), ("select id from t order by id desc", "select id from t order by id", False), ("select id from t order by id desc", "select id from t", True), ("select id from t where id < 3", "select id from t", False), ("select x from t", "select id from t", False), ("select id from t", "select x from t", False), (None, "select id from t", False)]
    df = spark.createDataFrame([("d", p, g) for p, g, _ in pairs], "db_id string, pred string, gold string")
    got = {(r.pred, r.gold): r for r in I.judge_texts(df, images(spark)).collect()}
    assert {k: r.correct for k, r in got.items()} == {(p, g): c for p, g, c in pairs}
    assert [r.gold for r in got.values() if r.gold_error] == ["select x from t"]
    assert got[("select a, id from t", "select id, a from t")].same_set is False
    r = I.result_rows(df.selectExpr("db_id", "pred as sql"), images(spark), saved=1).where("sql = 'select a, id from t' and inst = 0").first()
    assert r.columns == ["a", "id"] and r.rows == [["Sx", "I1"]] and r.row_count == 3


def test_candidates_against_sqlite_and_spark(spark, data):
    e = X.pool_entries(spark, data)
    img = X.images_of(spark, data).where("inst < 2")
    sample = [(r.db_id, r.run_sql) for r in e.where("run_sql <> ''").orderBy(F.xxhash64("run_sql")).limit(60).collect()]
    got = {(r.db_id, r.sql): r for r in I.execute_texts(spark.createDataFrame(sample, "db_id string, sql string"), img).collect()}
    by: dict = {}
    for r in img.orderBy("db_id", "inst").collect():
        by.setdefault(r.db_id, []).append(I.open_image(bytes(r.image)))
    dbs = {}
    for db in {d for d, _ in sample}:
        dbs[db] = []
        for con in by[db]:
            tables = {}
            for name, ddl in con.execute("select name, sql from sqlite_master where type = 'table'").fetchall():
                cols = [(c[1], c[2]) for c in con.execute(f'pragma table_info("{name}")')]
                rows = con.execute(f'select * from "{name}"').fetchall()
                kinds = ["string" if k == "TEXT" else "double" if any(isinstance(r[n], float) for r in rows) else "bigint" for n, (_, k) in enumerate(cols)]
                tables[name] = spark.createDataFrame([tuple(float(v) if kind == "double" and v is not None else v for v, kind in zip(r, kinds)) for r in rows], ", ".join(f"`{c}` {k}" for (c, _), k in zip(cols, kinds)))
            dbs[db].append(tables)
    spark_runs = Executor(spark, dbs).run([(s, d) for d, s in sample])
    plain = lambda c: "N" if c == "N" else c[0].replace("F", "I") + (f"{float(c[1:]):.9g}" if c[0] in "IF" else c[1:])
    for db, sql in sample:
        want = []
        for k, con in enumerate(by[db]):
            try:
                rows = con.execute(sql).fetchall()
                want.append(I.digest(sorted(map(repr, rows))))
                o = spark_runs[(sql, db)][k]
                if o.ok and "limit" not in sql.lower():
                    from quorumframe.sqltools.executor import cell

                    assert sorted([plain(c) for c in r] for r in o.rows) == sorted([plain(cell(v)) for v in r] for r in rows), sql
            except sqlite3.Error:
                want.append("ERROR")
        assert got[(db, sql)].vector == want, sql


def test_winners_against_plain_rules(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(40):
        for k in range(rnd.randint(1, 6)):
            models = sorted(rnd.sample(["a", "b", "c"], rnd.randint(1, 3)))
            rows.append((q, [f"I{k}"], f"I{k}", rnd.randint(1, 4), models, len(models), "select 1 from t" + " join u" * rnd.randint(0, 3), round(rnd.random(), 3), rnd.random() < 0.2, rnd.random() < 0.1))
    g = spark.createDataFrame(rows, "qid int, vector array<string>, sig string, size bigint, models array<string>, n_models int, rep string, score double, is_empty boolean, is_zero boolean").withColumn("mean_score", F.col("score"))
    by = {}
    for r in g.collect():
        by.setdefault(r.qid, []).append(r)

    def ranked(gs):
        return [r for r in gs if not (r.is_empty or r.is_zero)] or gs

    def close(rs):
        t = sorted(rs, key=lambda r: (r["size"], r.sig), reverse=True)
        return t[0], t[0]["size"] < 2 or len(t) > 1 and t[0]["size"] - t[1]["size"] <= 1

    def gated(gs):
        first, hit = close(ranked(gs))
        return max(ranked(gs), key=lambda r: (r.n_models > 1, r["size"], -r.rep.count("join"), r.sig)) if hit else first

    def p03(gs):
        first, hit = close(ranked(gs))
        c = max(ranked(gs), key=lambda r: (r.n_models, r["size"], r.sig))
        return c if hit and (c.n_models, c["size"]) > (first.n_models, first["size"]) else first

    rules = {"vav": lambda gs: max(ranked(gs), key=lambda r: (r["size"], r.sig)), "gated": gated, "p03": p03, "soft_ladder": lambda gs: max(ranked(gs), key=lambda r: (r.n_models > 1, r["size"], r.sig))}
    every = {(r.arm, r.qid): r.sig for r in P.all_winners(g).collect()}
    for name, rule in rules.items():
        want = {q: rule(gs).sig for q, gs in by.items()}
        assert {r.qid: r.sig for r in P.ARMS[name](g).collect()} == want and {q: s for (a, q), s in every.items() if a == name} == want, name
    assert len(every) == 40 * len(P.RULES)


def test_order_aware_vote(spark, data):
    rows = {r.qid: r for r in X.run_order_aware(spark, data).collect()}
    assert rows and all((r.winner_changed or r.migration.startswith("same")) for r in rows.values())
    labels = {(r.qid, r.key): r.label for r in X.run_labels(spark, data).collect()}
    judged = {(r.qid, r.rep): r.correct for r in X.run_judged(spark, data).collect()}
    assert judged and all(labels[k] == int(v) for k, v in judged.items() if k in labels)


def test_catalog_and_files(spark, tmp_path):
    for db, name in (("d", "z_copy"), ("d", "d"), ("d", "a_copy"), ("e", "e")):
        (tmp_path / db).mkdir(exist_ok=True)
        (tmp_path / db / f"{name}.sqlite").write_bytes(I.image_of({name: (["x INTEGER"], [(1,)])}))
    got = {(r.db_id, r.inst): r for r in I.read_images(spark, str(tmp_path / "*")).collect()}
    assert sorted(got) == [("d", 0), ("d", 1), ("d", 2), ("e", 0)]
    assert [I.open_image(bytes(got[("d", k)].image)).execute("select name from sqlite_master").fetchone()[0] for k in range(3)] == ["d", "a_copy", "z_copy"]
    assert [tuple(r) for r in I.catalog_ddl(images(spark)).where("db_id = 'e'").orderBy("tbl").collect()][1] == ("e", "u", 'CREATE TABLE "u" (id INTEGER, v TEXT)')


@pytest.mark.parametrize("n", [0, 1])
def test_cache_runs_only_what_it_lacks(spark, tmp_path, n):
    from quorumframe.sources.cache import cached_vectors

    name = f"{tmp_path}-{n}"
    a = spark.createDataFrame([("d", "select 1")], "db_id string, sql string")
    b = spark.createDataFrame([("d", "select 1"), ("d", "select 2"), (None, "select 3")], "db_id string, sql string")
    assert cached_vectors(a, images(spark), spark, name).count() == 1
    assert {r.sql for r in cached_vectors(b, images(spark).where("false" if n else "true"), spark, name).collect()} == {"select 1", "select 2"}


def test_stored_values_and_samples(spark, data):
    img = X.images_of(spark, data).where("inst = 0")
    got = I.stored_values(img.limit(1)).collect()
    db = got[0].db_id
    con = I.open_image(bytes(img.where(F.col("db_id") == db).first().image))
    for t, c in {(r.tbl, r.col) for r in got if r.col}:
        want = sorted({v[0][:60] for v in con.execute(f'select "{c}" from "{t}" where "{c}" is not null').fetchall()})[:60]
        assert [r.value for r in sorted((r for r in got if (r.tbl, r.col) == (t, c)), key=lambda r: r.place)] == want
    assert {(r.tbl, r.place) for r in got if r.col is None} == {(t, k) for t in {r.tbl for r in got} for k in (1, 2, 3)}


def test_soft_scores_and_keys(spark):
    from quorumframe.operators.equality import soft_f1

    pairs = [("select a, id from t", "select id, a from t"), ("select id from t", "select id, a from t"), ("select id as x from t", "select id from t"), ("select no from t", "select id from t"), ("select id from t where id > 1", "select id from t")]
    df = spark.createDataFrame([("e", p, g) for p, g in pairs], "db_id string, pred string, gold string")
    got = {(r.sql, r.gold): (round(r.f1, 6), r.n) for r in I.soft_scores(df, images(spark)).collect()}
    assert got[pairs[0]] == (1.0, 1) and got[pairs[3]] == (0.0, 1) and got[pairs[2]] == (0.0, 1)
    assert got[pairs[1]][0] == soft_f1([["I1"], ["I2"], ["I3"]], [["I1", "Sx"], ["I2", "Sx"], ["I3", "N"]], ["id"], ["id", "a"])
    assert got[pairs[4]][0] == round(2 * 1.0 * (2 / 3) / (1.0 + 2 / 3), 6)
    keyed = {(r.pred, r.gold): r.equal for r in I.keyed_match(df, images(spark)).collect()}
    assert [keyed[p] for p in pairs] == [True, False, True, False, False]
    assert I.soft_scores(df.limit(0), images(spark)).count() == 0 and I.keyed_match(df.limit(0), images(spark)).count() == 0


def test_consensus_against_all_scores(spark, data):
    rows = {r.qid: r for r in X.run_consensus(spark, data).collect()}
    assert rows and all(r.by_candidate and r.by_group for r in rows.values())
    e = X.executed_entries(spark, data).where(~F.array_contains("vector", "ERROR"))
    g = X.groups_of(e)
    vav = {r.qid: r.rep for r in P.arm_vav(g).collect()}
    text = {(r.qid, r.key): (r.db_id, r.run_sql) for r in e.collect()}
    groups = [(r.qid, r.rep, r["size"], r.v) for r in g.select("qid", "rep", "size", F.md5("sig").alias("v")).collect()]
    pairs = {(*text[(q, rep)], text[(q, vav[q])][1]) for q, rep, _, _ in groups if q in vav}
    f1 = {(r.db_id, r.sql, r.gold): round(r.f1, 6) for r in I.soft_scores(spark.createDataFrame(sorted(pairs), "db_id string, pred string, gold string"), X.images_of(spark, data)).collect()}
    want = {}
    for q, rep, size, v in groups:
        if q in vav:
            key = (round(size * f1[(*text[(q, rep)], text[(q, vav[q])][1])], 6), size, v)
            want[q] = max(want.get(q, (key, rep)), (key, rep))
    assert {q: r.by_group for q, r in rows.items()} == {q: rep for q, (_, rep) in want.items()}


def test_phases(spark, data):
    r = {x.phase: x for x in X.run_phases(spark, data).collect()}
    e = X.executed_entries(spark, data)
    assert r["group"].tasks == e.agg(F.sum("votes")).first()[0] and r["group"].executed == e.select("db_id", "run_sql").distinct().count()
    assert all(x.tasks == x.hits + x.executed for x in r.values()) and r["group"].runs == X.INSTANCES * r["group"].executed
    # Each question's winner was run in the first phase, so at least half of the judgement's tasks are hits.
    assert r["judge"].hits * 2 >= r["judge"].tasks and r["group"].interrupted == r["group"].timeouts == 0


def shop(seed):
    """An instance with keys, nulls, whole and broken numbers."""
    r = random.Random(seed)
    a = [(k + 1, r.choice(["p", "Q", "q", None]), r.choice([1, 2, 2.5, -3, None]), r.randrange(5)) for k in range(12)]
    b = [(k + 1, r.choice([1, 2, 3, 40, None]), r.choice(["x", "y", None])) for k in range(9)]
    return I.image_of({"a": (['"a_id" NUMERIC PRIMARY KEY', '"name" TEXT', '"size" NUMERIC', '"rank" NUMERIC'], a), "b": (['"b_id" NUMERIC PRIMARY KEY', '"a_id" NUMERIC', '"kind" TEXT'], b)})


SHOP = [
    "select name, size from a where size >= 2", "SELECT [name] FROM [a] WHERE [size]=-3 OR name LIKE 'q%'", 'select "name" from "a" where "name" = "p"', "select name from a where kind = 'x'", "select count(*), count(distinct name) from a where size != 2",
    "select name, sum(size), avg(rank) from a where rank > 0 group by name having count(*) > 1", "select max(size), min(name) from a", "select size from a order by size desc limit 3", "select name from a where size not in (1, 2)", "select name from a where size between 1 and 2 and name is not null",
    "select a.name, b.kind from a join b on a.a_id = b.a_id where b.kind = 'x'", "select a.name, b.kind from a join b on a.a_id = b.a_id where a.size > 1 and b.kind is not null", "select name from a where a_id in (select a_id from b where kind = 'y')", "select name from a where a_id not in (select a_id from b)",
    "select name from a where size > 'p'", "select rowid from a where size = 2", "select sql from sqlite_master", "select 1e1 from a", "select a_id from a where a_id in (7, 3) or rank = 1", "select avg(size) from a where name = 'nobody'", "select sum(size) from a where size < 1000000.5", "select nothing from a",
]


def test_texts_compiled_once_give_what_each_instance_gives(spark):
    shops = [shop(k) for k in range(6)]
    inst = I.Instances(shops)
    assert inst.reader is not None
    forms = {t: inst.form(t) for t in SHOP}
    inst.ready(list(forms.values()), I.Limits())
    assert sum(x is not None for x in inst.answers.values()) >= 14
    for k, image in enumerate(shops):
        con = I.open_image(image)
        for t, f in forms.items():
            want, got = I.run_text(con, t, I.Limits()), inst.run(k, f)
            assert (repr(got.rows), got.count, got.error_type) == (repr(want.rows), want.count, want.error_type), t
    inst.close()


def test_texts_of_one_form_run_once(spark, monkeypatch):
    db = spark.createDataFrame([("d", k, bytearray(shop(k))) for k in range(3)], "db_id string, inst int, image binary")
    texts = ["select name from a where rank>1", "SELECT name  FROM a WHERE rank > 1", "select [name] from [a] where [rank] > 1;", "select wrong from a", "SELECT WRONG FROM a"]
    got = {r.sql: r for r in I.execute_texts(spark.createDataFrame([("d", t) for t in texts], "db_id string, sql string"), db).collect()}
    assert got[texts[0]].vector == got[texts[1]].vector == got[texts[2]].vector == [I.sign(I.run_text(I.open_image(shop(k)), texts[0], I.Limits()), I.CAP)[0] for k in range(3)]
    assert got["select wrong from a"].error == "no such column: wrong" and got["SELECT WRONG FROM a"].error == "no such column: WRONG"
    inst = I.Instances([shop(k) for k in range(3)])
    assert len({inst.form(t) for t in texts[:3]}) == 1


def test_soft_scores_of_equal_results(spark):
    db = spark.createDataFrame([("d", k, bytearray(shop(k))) for k in range(4)], "db_id string, inst int, image binary")
    from quorumframe.operators.equality import soft_f1
    from quorumframe.sqltools.executor import cell

    pairs = [(p, "select name, size from a where size >= 2") for p in ("select name, size from a where size >= 2", "select size, name from a where size > 1", "select name as n from a", "select wrong from a", "select name from a where size > 99", "select count(*) from a")]
    got = {r.sql: r.f1 for r in I.soft_scores(spark.createDataFrame([("d", *p) for p in pairs], "db_id string, pred string, gold string"), db).collect()}
    for p, g in pairs:
        each = []
        for k in range(4):
            con = I.open_image(shop(k))
            x, y = I.run_text(con, p, I.Limits()), I.run_text(con, g, I.Limits())
            rows = lambda r: [[cell(v) for v in t] for t in r.rows]
            each.append(soft_f1(rows(x), rows(y), list(x.columns), list(y.columns)) if x.ok else 0.0)
        assert got[p] == pytest.approx(sum(each) / 4), p


def test_figures_of_one_pass_are_those_of_the_vectors(spark):
    db = spark.createDataFrame([("d", k, bytearray(shop(k))) for k in range(4)], "db_id string, inst int, image binary")
    texts = [*SHOP, *[f"select name from a where size > {k} order by rank desc limit {k % 4}" for k in range(9)], "", "drop table a"]
    rows = spark.createDataFrame([(n, d, t) for n, t in enumerate(texts * 2) for d in ("d", "none")], "n int, db_id string, sql string")
    got = I.with_figures(rows, db, ["n", "db_id", "sql"]).collect()
    want = {(r.db_id, r.sql): r for r in I.execute_texts(rows, db).collect()}
    assert len(got) == 4 * len(texts) and sum(r.fresh for r in got) == 2 * len(texts)
    images_ = [I.open_image(shop(k)) for k in range(4)]
    for r in got:
        w = want[r.db_id, r.sql]
        at = next((k for k, x in enumerate(w.error_types) if x), None)
        assert (r.sig, r.runs, r.failed_at, r.failures) == (hashlib.md5("|".join(w.vector).encode()).hexdigest(), len(w.vector), at, sum(map(bool, w.error_types))), r.sql
        assert r.is_empty == (not any(f & I.HAS_CELL for f in w.flags)) and (r.vec is None or r.vec.hex() == "".join(w.vector))
        assert not w.vector or w.vector == [I.sign(I.run_text(c, r.sql, I.Limits()), I.CAP)[0] for c in images_]


def test_groups_without_vectors(spark, data, monkeypatch):
    want = {tuple(r) for r in X.groups_of(X.executed_entries(spark, data)).select("qid", F.md5("sig"), "size", "n_keys", "n_models", "rep", "is_empty", "is_zero").collect()}
    monkeypatch.setattr(X, "cached_vectors", None)  # the groups need no table of vectors
    assert {tuple(r) for r in X.run_groups(spark, data).collect()} == want


def test_first_failures_without_vectors(spark, data, monkeypatch):
    e = X.executed_entries(spark, data).select("qid", "key", "error_types").collect()
    at = {(r.qid, r.key): next(((k, x) for k, x in enumerate(r.error_types) if x), None) for r in e}
    monkeypatch.setattr(X, "cached_vectors", None)
    got = X.first_failure(spark, data).collect()
    assert {(r.qid, r.key): (r.inst, r.error_type) for r in got} == {k: v for k, v in at.items() if v}
    assert {r.rate for r in got} == {round(len(got) / len(at), 6)}


def test_phases_without_vectors(spark, data, monkeypatch):
    e = X.executed_entries(spark, data)
    texts = e.select("db_id", "run_sql", F.size(F.filter("error_types", lambda x: x != "")).alias("n")).distinct().collect()
    monkeypatch.setattr(X, "cached_vectors", None)
    r = {x.phase: x for x in X.run_phases(spark, data).collect()}
    assert (r["group"].executed, r["group"].failures) == (len(texts), sum(t.n for t in texts))
    won = {x.qid for x in X.run_groups(spark, data).collect()}
    gold = {(g.db_id, g.gold) for g in X.golds(spark, data).collect() if g.qid in won}
    assert r["judge"].executed == len(gold - {(t.db_id, t.run_sql) for t in texts})


def test_accuracy_without_vectors(spark, data, monkeypatch):
    e = X.executed_entries(spark, data)
    w = P.all_winners(X.groups_of(e)).select("arm", "qid", "rep")
    want = {r.arm: (r.n, r.n_correct) for r in X.winners_judged(spark, data, e, w).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("n_correct")).collect()}
    monkeypatch.setattr(X, "cached_vectors", None)
    got = {r.arm: (r.n, r.n_correct) for r in X.run_accuracy(spark, data).where("pool = 'both'").collect()}
    assert got == want and len(got) == len(P.RULES)


def test_soft_scores_of_whole_results(spark):
    n = 60
    image = I.image_of({"t": (["id INTEGER", "a TEXT"], [(k, f"x{k % 5}") for k in range(n)])})
    db = spark.createDataFrame([("d", 0, bytearray(image))], "db_id string, inst int, image binary")
    gold = "select p.id as i, q.a as b from t as p, t as q"
    preds = [f"{gold} where p.id > 0", "select p.id as i, 'x0' as b from t as p, t as q", "select p.id as x, q.a as y from t as p, t as q"]
    rows = spark.createDataFrame([("d", p, gold) for p in preds], "db_id string, pred string, gold string")
    want = {preds[0]: 2 * (n - 1) / (2 * n - 1), preds[1]: (n * n + n * n // 5) / (2 * n * n), preds[2]: 0.0}
    for limits in (I.Limits(), I.Limits(cap=10)):
        assert {r.sql: round(r.f1, 6) for r in I.soft_scores(rows, db, limits).collect()} == {p: round(f, 6) for p, f in want.items()}
