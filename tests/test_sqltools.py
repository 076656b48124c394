"""Parser, structure and guarded execution; execution is held against SQLite."""

import sqlite3

import pytest

from quorumframe.plans.structure import CORPUS, INSTANCES, star_instances
from quorumframe.sqltools import analysis as A
from quorumframe.sqltools.executor import Executor, cell, is_safe
from quorumframe.sqltools.parser import ParseError, parse
from quorumframe.functions import sqltext as Q


@pytest.mark.parametrize("bad", ["", "select", "select a from", "select a, from t", "select a from t where (b = 1", "drop table t", "select a from t; select b from u", "select a from t where b in (1,"])
def test_no_query(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_tree():
    q = parse("select a.x, count(distinct b) n from t as a left join u on a.id = u.id where not x like '%;--''%' and y between 1 and 2 group by a.x, z having count(*) > 1 order by n desc, 1 limit 5, 10")
    assert q["limit"] == 10 and q["offset"] == 5 and len(q["group"]) == 2 and q["from"][1]["join"] == "left" and q["order"][0][1] == "desc"
    old = parse("select x from t group by a, b order by c, d desc limit 7", legacy=True)
    assert len(old["group"]) == 1 and len(old["order"]) == 1 and old["order"][0][1] == "desc" and old["limit"] == 1


@pytest.mark.parametrize(("sql", "level"), [("select a from t", "easy"), ("select a, b from t where c = 1", "medium"), ("select a from t where b in (select b from u)", "hard"), ("select a, count(*) from t join u on t.i = u.i where c like 'x' group by a order by count(*) limit 1", "extra"), ("selec", "unparsed")])
def test_hardness(sql, level):
    assert A.hardness(sql) == level


def test_exact_match():
    assert A.exact_match("select b, a from t where x = 1 and y = 2", "SELECT a, b FROM t WHERE y = 5 AND x = 7")
    assert A.exact_match("select t.a from t join u on t.i = u.i", "select a.a from t as a join u as b on a.i = b.i")
    assert not A.exact_match("select a from t order by a", "select a from t order by a desc")
    assert not A.exact_match("select max(a) from t", "select min(a) from t")
    assert A.exact_match("select", "select a from t") is False and A.exact_match("select a from t", "x") is None
    links = A.foreign_key_links([("u.tid", "t.id"), ("v.tid", "u.tid")])
    assert links["u.tid"] == links["v.tid"] == links["t.id"] and A.exact_match("select u.tid from t, u", "select t.id from t, u", links)


def test_atomic_ops():
    ops = A.atomic_ops("select count(*) from t as x join u as y on x.i = y.i where y.a > 1 and x.b = 2 limit 3")
    assert ops == ["FROM(t)", "ALIAS(t,T1)", "JOIN(u,inner)", "ALIAS(u,T2)", "ON_EQ(T1.i = T2.i)", "WHERE_PRED(2 = T1.b)", "WHERE_PRED(T2.a > 1)", "SELECT_AGG(count(*))", "LIMIT(3)"]
    assert A.atomic_jaccard("select a from t", "select a from t") == 1.0 and A.atomic_ops("no") is None


def test_text_scanners():
    assert Q.normalize_sql("SELECT  Name FROM  T WHERE x = 'A  B' AND ( y IN ( 1, 2 ) );") == "select Name from T where x = 'A  B' and (y in (1, 2))"
    assert Q.find_semicolon("select ';' ; x") == 11 and Q.is_multi_statement("a; b") and not Q.is_multi_statement("a ;; ")
    assert Q.partialize("select a from t where b in (select c from u group by d) group by e limit 1") == ("select a from t where b in (select c from u group by d)", "scan")
    assert Q.related_tables("with c as (select 1 from z) select * from c, T1 join `u` on 1 = 1 where x in (select y from v)") == ["t1", "u", "v", "z"]
    assert Q.ddl_to_lines("CREATE TABLE t (id INTEGER PRIMARY KEY, n TEXT, p DECIMAL(3,2), FOREIGN KEY (n) REFERENCES u(i));") == ["t.id:INTEGER PK", "t.n:TEXT", "t.p:DECIMAL"]


def test_gate():
    assert is_safe("select 'drop' from t") and not is_safe("DELETE FROM t") and not is_safe("select replace(a, 'b', 'c') from t") and not is_safe("")
    assert [cell(v) for v in (None, True, 3, 1.5, "x", b"\xff")] == ["N", "I1", "I3", "F1.5", "Sx", "Sff"]


def test_execution_against_sqlite(spark, data):
    insts = star_instances(spark, data)
    ex = Executor(spark, {"star": insts})
    got = ex.run([(t, "star") for t in CORPUS] * 2)
    assert ex.stats["executed"] == len(CORPUS) and ex.stats["hits"] == len(CORPUS) and ex.stats["lifted"] >= 10
    kinds = {t: o[0].error_type for (t, _), o in got.items() if not o[0].ok}
    assert kinds == {"DROP TABLE orders": "safety_rejection", "SELECT 1; SELECT 2": "multi_statement", "SELECT nothing FROM orders": "sqlite_error", "SELECT o_orderkey FROM orders WHERE (o_orderkey = 1": "sqlite_error", "": "empty_sql"}
    for k in range(INSTANCES):
        con = sqlite3.connect(":memory:")
        for t, df in insts[k].items():
            df.toPandas().astype({c: str for c, kind in df.dtypes if kind == "timestamp"}).to_sql(t, con, index=False)
        for (sql, _), o in got.items():
            if o[k].ok:
                want = [[cell(v) for v in r] for r in con.execute(sql).fetchall()]
                ordered = "order by" in sql.lower()
                assert (o[k].rows == want) if ordered else (sorted(o[k].rows) == sorted(want)), sql


def test_caps_and_unknown_database(spark):
    ex = Executor(spark, {"d": [{"t": spark.range(50).toDF("id")}]}, cap=15)
    (o,) = ex.run_text("select id from t order by id", "d")
    assert o.ok and o.truncated and len(o.rows) == 15 and o.row_count == 50  # rows beyond the cap are counted
    assert ex.run_text("select 1", "none")[0].error_type == "db_not_found"
    (e,) = ex.run_text("select count(*), max(id) from t where id > 99", "d")
    assert e.rows == [["I0", "N"]]


def test_filters_and_bodies_count():
    assert not A.exact_match("select count(*) filter (where id < 5) from t", "select count(*) from t")
    assert A.atomic_jaccard("with c as (select a from t where b > 1) select a from c", "with c as (select a from u where b > 2) select a from c") < 1.0
    assert "ENTER_SUBQUERY" in A.atomic_ops("select (select max(a) from t) from u")


def test_filter_of_an_aggregate_is_run(spark):
    ex = Executor(spark, {"d": [{"t": spark.range(50).toDF("id")}, {"t": spark.range(3).toDF("id")}]})
    got = ex.run_text("select count(*) filter (where id < 5), sum(id) from t", "d")
    assert [o.rows for o in got] == [[["I5", "I1225"]], [["I3", "I3"]]]


def test_signatures_without_rows_on_the_driver(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string"), spark.createDataFrame([], "x int, y string")
    ex = Executor(spark, {"d": [{"t": one}, {"t": two}]})
    texts = ["select x, y from t", "select x, y from t order by x desc", "select y, x from t", "select distinct x, y from t", "select x + 0.0, y from t", "select x, y from t where x not in (select x from t where y = 'z')", "select no from t", "drop table t"]
    r = {(x.sql_text, x.inst): x for x in ex.signatures([(t, "d") for t in texts], spark).collect()}
    sig = [r[(t, 0)].sig for t in texts]
    assert sig[0] == sig[1] == sig[5] and len(set(sig[:5])) == 4 and sig[6] == sig[7] == "ERROR" and all(r[(t, 1)].sig == "E" for t in texts[:5])
    assert r[(texts[0], 0)].ordered_sig != r[(texts[1], 0)].ordered_sig and r[(texts[3], 0)].row_count == 2 and r[(texts[7], 0)].error_type == "safety_rejection"


def test_deadline(spark):
    import time

    n = spark.range(40_000).selectExpr("id", "1 as k")
    ex = Executor(spark, {"d": [{"t": n, "u": n}]}, timeout=0.5)
    began = time.time()
    (o,) = ex.run_text("select count(*) from t join u on t.k = u.k and t.id + u.id <> 7", "d")
    assert not o.ok and o.error_type in ("timeout", "worker_hang") and time.time() - began < 12


def test_equal_texts_run_once(spark):
    ex = Executor(spark, {"d": [{"t": spark.range(4).toDF("id")}]})
    ex.run([("SELECT id  FROM t", "d"), ("select id from t;", "d"), ("select id from t", "d")])
    assert ex.stats["executed"] == 1 and ex.stats["hits"] == 2
