"""Every llm query runs; those with SQL agree with it."""

import pytest

from quorumframe.llm import queries as L

from ..helpers import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(L.QUERIES))
def test_query(spark, data, duck, name):
    got = spark_rows(L.QUERIES[name](spark, data))
    assert len(got[1]) == len(set(got[1]))
    if name in L.SQL:
        assert got == duck_rows(duck, L.SQL[name])


COLUMNS = {"p1_found": "di:int, result_hash:string, rnk:int", "p2_found": "response_id:bigint", "p3_found": "response_id:bigint, defect:string", "p5_found": "keep_id:bigint, copy_id:bigint", "p6_found": "window_id:int, doc_id:bigint", "p7_found": "doc_id:bigint, item_id:bigint", "p8_found": "doc_id:bigint, kind:string"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert ", ".join(f"{a}:{b}" for a, b in L.QUERIES[name](spark, data).dtypes) == COLUMNS[name]
