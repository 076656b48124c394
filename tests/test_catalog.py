"""Every core query runs; those with SQL agree with it."""

import pytest

from quorumframe.plans import catalog

from .helpers import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    got = spark_rows(catalog.QUERIES[name](spark, data))
    if name in catalog.SQL:
        assert got == duck_rows(duck, catalog.SQL[name])


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_core_does_not_need_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['quorumframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_all_set_operations_read_whole_tables(spark, data):
    from collections import Counter

    lines = Counter(r.k for r in spark.read.parquet(f"{data}/lineitem.parquet").selectExpr("l_linenumber as k").collect())
    sizes = Counter(r.k for r in spark.read.parquet(f"{data}/part.parquet").where("p_size < 8").selectExpr("p_size as k").collect())
    for name, want in (("set_except_all_counts", lines - sizes), ("set_intersect_all_counts", lines & sizes)):
        assert {r.k: r.n for r in catalog.QUERIES[name](spark, data).collect()} == dict(want)
