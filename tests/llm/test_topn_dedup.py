"""Top n per group and hidden duplicates against brute force, and their defined cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quorumframe.llm import dedup as D
from quorumframe.llm.topn import top_n_per_group

SAME = [
    ("SELECT a, b FROM t WHERE x = 1 AND y = 2;", 'select `b`,[a]\nfrom "t" where y=2 and x=1'),
    ("select a from t where x between 1 and 2 and y='Q r'", 'SELECT a FROM t WHERE y="q R" AND x BETWEEN 1 AND 2;;'),
    ("select count( * ) from t", "SELECT COUNT(*) FROM t ;\n"),
    ("select a from t where x in ('p', \"q\")", "select a from t where x in (\"p\",'q')"),
    ("select a from t where x > = 3", "select a from t where x>=3"),
    ('select "t"."a", b from t join u on t.id = "u"."id"', "select b, t.a from t join u on t.id=u.id"),
    ("select a from t where i in (select i from u where p = 1 and q = 2)", "select a from t where i in (select i from u where q=2 and p=1)"),
    ("select a from t where x > -5", "select a from t where x>- 5"),
]
OTHER = [
    ("select a from t where x = 1 or y = 2 and z=3", "select a from t where z=3 and y=2 or x=1"),
    ("select a from t where x='a b'", "select a from t where x='a  b'"),
    ("select a from t where (x=1)", "select a from t where x=1"),
    ("select a from t where x=1.0", "select a from t where x=1"),
    ("select a from t where x=-1", "select a from t where x=1"),
    ("select a from t order by a,b", "select a from t order by b,a"),
    ("select distinct a from t", "select a from t"),
    ("select a from t where x!=1", "select a from t where x<>1"),
    ("select a from t where x='b'", "select a from t where x=b"),
    ("select a from t where x in (1,2)", "select a from t where x in (2,1)"),
    ("select a from t where x like '%b'", "select a from t where x like 'b'"),
    ("select a from t where x='p,q' and y=1", "select a from t where x='q,p' and y=1"),
    ("select a from t where x='p and q'", "select a from t where x='q and p'"),
]


def test_canonical():
    for a, b in SAME:
        assert D.canonical_sql(a) == D.canonical_sql(b), (a, b)
    for a, b in OTHER:
        assert D.canonical_sql(a) != D.canonical_sql(b), (a, b)
    assert D.canonical_sql(None) is None and D.canonical_sql(" ;\n") is None
    for t in ("select 'open", "select (a", "select [x", '"', "'", "((((", "select a from t where", "x" * 100_000):
        assert D.canonical_sql(t) is not None


def test_filter_has_no_false_negatives():
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    bits = D.filter_plan(3000)[1]
    parts = [rnd.integers(-(2**62), 2**62, 1000) for _ in range(3)]
    parts[1][:50] = parts[0][:50]
    parts[2][-5:] = parts[2][0]
    out = []
    for p in parts:
        out += [b for b in D.partial_filters(bits)(iter([pa.RecordBatch.from_arrays([pa.array(p)], names=["h"])]))]
    out.sort(key=lambda b: b.column(0)[0].as_py())
    twice = {b.column(0)[0].as_py(): np.unpackbits(np.frombuffer(D.zlib.decompress(b.column(1)[0].as_py()), np.uint8)) for b in D.merge_filters(iter(out))}
    full = np.concatenate([twice.get(s, np.zeros(D.SEGMENT_BITS, np.uint8)) for s in range(bits // D.SEGMENT_BITS)])
    hit = lambda h: np.logical_and.reduce([full[q.astype(np.int64)] for q in D.positions(h, bits)])
    assert hit(parts[0][:50]).all() and hit(parts[2][:1]).all()
    assert hit(parts[0][50:]).mean() < 0.05


@pytest.mark.parametrize("rows", [0, 60, 4000])
def test_copies(spark, rows, monkeypatch):
    rnd = random.Random(rows)
    monkeypatch.setattr(D, "HOT_GROUPS", 4)
    data = []
    for i in range(rows):
        hot = rnd.random() < 0.33
        a, b = (1, 2) if hot else (rnd.randrange(60), rnd.randrange(60))
        items = ["p", "q"]
        rnd.shuffle(items)
        sql = rnd.choice([f"SELECT {items[0]}, {items[1]} FROM t WHERE x={a} AND y={b};", f"select {items[0]},{items[1]} from [t] where y = {b} and x = {a}", None if rnd.random() < 0.1 else f"select p,q from t where x={a} and y={b}", " "])
        data.append((i, rnd.choice(["D", " d "]) if hot or a % 2 else None, sql, "x"))
    data += data[:7]
    k = D.Copies(spark.createDataFrame(data, "id long, db_id string, sql_text string, keep_id string"), spark)
    groups = defaultdict(set)
    for i, db, sql, _ in data:
        c = D.canonical_sql(sql)
        if c is not None:
            groups[((db or "").strip().lower(), c)].add(i)
    assert sorted(tuple(r) for r in k.pairs().collect()) == sorted((min(v), i) for v in groups.values() for i in v if i != min(v))
    assert sorted(tuple(r) for r in k.records().collect()) == sorted((min(v), len(v)) for v in groups.values())


def test_top_n(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, rnd.randrange(40), None]), rnd.choice("abcdefgh") + str(rnd.randrange(9)), rnd.choice([None, *range(6)]), 1) for _ in range(3000)]
    rows += rows[:50]
    best = defaultdict(dict)
    for g, i, s, _ in rows:
        if g is not None and s is not None:
            best[g][i] = max(best[g].get(i, s), s)
    want = sorted((g, i, s, k + 1) for g, v in best.items() for k, (s, i) in enumerate(sorted(((s, i) for i, s in v.items()), reverse=True)[:3]))
    df = spark.createDataFrame(rows, "g int, i string, s int, rnk int").repartition(7)
    assert sorted(tuple(r) for r in top_n_per_group(df, "g", "i", "s", 3).collect()) == want
    assert top_n_per_group(df.limit(0), "g", "i", "s").count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "i", "s", 0)


def test_canonical_case():
    same = [
        ("SELECT a FROM t WHERE b = 1 AND CASE WHEN c = 2 OR d = 3 THEN 1 ELSE 0 END = 1", "SELECT a FROM t WHERE CASE WHEN c = 2 OR d = 3 THEN 1 ELSE 0 END = 1 AND b = 1"),
        ("SELECT a FROM t WHERE CASE WHEN c = 2 THEN CASE WHEN e = 1 THEN 1 END ELSE 0 END = 1 AND b = 1", "SELECT a FROM t WHERE b = 1 AND CASE WHEN c = 2 THEN CASE WHEN e = 1 THEN 1 END ELSE 0 END = 1"),
        ("SELECT CASE WHEN a = 1 THEN \"x\" ELSE \"y\" END FROM t", "SELECT CASE WHEN a = 1 THEN 'x' ELSE 'y' END FROM t"),
        ("SELECT lower(\"a\") FROM t", "SELECT lower(a) FROM t"),
    ]
    for a, b in same:
        assert D.canonical_sql(a) == D.canonical_sql(b), (a, b)
    assert D.canonical_sql("SELECT a FROM t WHERE CASE WHEN c = 2 AND d = 3 THEN 1 END = 1") != D.canonical_sql("SELECT a FROM t WHERE CASE WHEN c = 2 THEN 1 AND d = 3 END = 1")
    assert D.canonical_sql("SELECT a FROM t WHERE b = 1 OR CASE WHEN c = 2 THEN 1 END = 1") != D.canonical_sql("SELECT a FROM t WHERE CASE WHEN c = 2 THEN 1 END = 1 OR b = 1")


def test_passes_keep_the_filter_sharp(spark, data, monkeypatch):
    c = spark.read.parquet(f"{data}/candidates.parquet").union(spark.read.parquet(f"{data.replace('0.001', '0.01')}/candidates.parquet"))
    one = D.Copies(c, spark)
    assert one.passes == 1
    monkeypatch.setattr(D, "BITS_PER_ROW", 16 << 10)  # as if there were a thousand times as many rows for a filter of 2^20 bits a pass
    monkeypatch.setattr(D, "MAX_BITS", 1 << 20)
    many = D.Copies(c.limit(1500), spark)
    assert many.passes > 4
    monkeypatch.undo()
    few = D.Copies(c.limit(1500), spark)
    rows = lambda k: sorted(tuple(r) for r in k.records().collect())
    assert rows(many) == rows(few) and sorted(map(tuple, many.pairs().collect())) == sorted(map(tuple, few.pairs().collect()))
    single = many.groups.where("n_copies = 1").count()
    assert single <= 0.05 * sum(n == 1 for _, n in rows(few))


def test_filter_plan_holds_at_every_size():
    for rows in (0, 1, 10**5, 10**7, 10**8, 10**9, 10**10):
        passes, bits = D.filter_plan(rows)
        load = 1 - (1 - 1 / bits) ** (D.PROBES * max(1, rows) / passes)
        assert bits <= D.MAX_BITS and load**D.PROBES < 0.01, rows
