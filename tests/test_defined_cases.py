"""Nulls, empty tables, ties, repeated rows and extra columns of the newer operators have one defined result."""

import json

from pyspark.sql import functions as F

from quorumframe.operators import drift
from quorumframe.operators import evidence as V
from quorumframe.operators import pool as P
from quorumframe.operators import stats as S
from quorumframe.functions import textops as T
from quorumframe.sources import readers as R

FILES = "file_id long, series_id long, family string, written_at timestamp, ingested_at timestamp, payload string, field string"


def files(spark, rows):
    import datetime

    at = lambda k: datetime.datetime(2031, 1, 1) + datetime.timedelta(hours=k)
    return spark.createDataFrame([(i, s, "f", at(k), at(k), None if p is None else json.dumps(p), "x") for i, s, k, p in rows], FILES)


def test_one_table_for_renamed_fields(spark):
    rows = [(5, 1, 0, {"match_rate": 0.5, "b": 1}), (2, 1, 1, {"exec_match_rate": 0.6, "b": "2"}), (3, 2, 0, {"exec_match_rate": 0.7}), (4, 2, 1, None), (2, 1, 1, {"exec_match_rate": 0.6, "b": "2"})]
    got = sorted((r.file_id, r.field, r.path, r.type, r.canonical) for r in drift.consistent_table(files(spark, rows), spark).collect())
    name = {r[1] for r in got if r[2].endswith("match_rate")}
    assert len(name) == 1 and len(got) == 5 and {r[1] for r in got} == {"b", *name}
    f = {(r.path, r.type): r.first_file for r in drift.fused_schema(files(spark, rows), drift.unified_table(files(spark, rows))).collect()}
    assert f[("b", "number")] == 5 and f[("exec_match_rate", "number")] == 3  # the first by time, not by id
    side = [(1, 1, 0, {"match_rate": 1}), (2, 1, 1, {"exec_match_rate": 1}), (3, 2, 0, {"match_rate": 1, "exec_match_rate": 2})]
    assert {r.field for r in drift.consistent_table(files(spark, side), spark).collect()} == {"match_rate", "exec_match_rate"}
    assert drift.consistent_table(files(spark, []), spark).count() == 0


def test_renames_look_at_values(spark):
    old, new = {"run_a_path": "x/yy", "run_b_path": 7}, {"run_c_path": 9, "run_d_path": "z/ww"}
    got = {(r.field_from, r.field_to) for r in drift.schema_changes(files(spark, [(1, 1, 0, old), (2, 1, 1, new)]), spark).where("change = 'renamed'").collect()}
    assert ("run_a_path", "run_d_path") in got or not got


def test_rules_on_no_groups_and_ties(spark):
    kind = "qid int, sig string, size bigint, models array<string>, n_models int, rep string, score double, mean_score double, is_empty boolean, is_zero boolean, w int"
    none = spark.createDataFrame([], kind)
    assert P.all_winners(none).count() == 0
    tie = spark.createDataFrame([(1, s, 2, ["a"], 1, f"select {s}", None, None, False, False, 3) for s in ("I1", "I2")] + [(2, "E", 1, ["a"], 1, "select 0", 0.5, 0.5, True, False, 3)], kind)
    got = {(r.arm, r.qid): r.sig for r in P.all_winners(tie).collect()}
    assert all(got[(a, 1)] == "I2" for a in ("vav", "gated", "p03", "tiebreak", "grouphead")) and got[("vav", 2)] == "E"


def test_ranks_in_ranges(spark):
    rows = [("a" if k % 3 else "b", (k * 37) % 200) for k in range(3000)] + [("c", None), (None, 3), ("d", 5)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): r.r for r in S.tie_ranks(df, "v", ["g"], "r").collect()}
    for g in ("a", "b", "d"):
        vs = sorted(v for h, v in rows if h == g)
        for v in set(vs):
            first = vs.index(v) + 1
            assert got[(g, v)] == first + (vs.count(v) - 1) / 2
        for share in (0.0, 0.5, 0.9, 1.0):
            p = S.index_percentile(df.where(F.col("g") == g), "v", share, ["g"]).first().p
            assert p == vs[min(int(len(vs) * share), len(vs) - 1)]
    assert not any(k[0] in (None, "c") for k in got) and S.tie_ranks(df.limit(0), "v", ["g"], "r").count() == 0


def test_exact_paired_test(spark):
    cases = [(0, 0), (5, 0), (3, 4), (40, 60), (700, 900), (2, 3000), (5000, 5000)]
    df = spark.createDataFrame(cases, "a bigint, b bigint")
    for r in df.select("a", "b", S.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect():
        assert abs(r.p - S.mcnemar(r.a, r.b)) < 1e-9, r


def test_sections_and_points(spark):
    s = spark.createDataFrame([("d", ["orders", "city"], [(-1, "*"), (0, "id"), (0, "price"), (1, "id"), (1, "name")], ["text", "number", "number", "number", "text"], [1, 3], [(1, 3)])], "db_id string, table_names_original array<string>, column_names_original array<struct<table_idx:int,column_name:string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<struct<from_col:int,to_col:int>>")
    q = spark.createDataFrame([(1, "d", "prices of cities and city"), (2, "d", None), (3, "none", "x"), (4, "d", "")], "di int, db_id string, question string")
    p = V.relevance(q, s)
    assert sorted((r.di, r.tbl, r.points) for r in p.collect()) == [(1, "city", 3), (1, "orders", 2), (4, "city", 0), (4, "orders", 0)]
    full = "city(id:number (PK), name:text)\norders(id:number (PK,FK→city.id), price:number)"
    assert {r.di: r.section for r in V.schema_sections(p, s).collect()} == {1: full, 4: full}
    assert {r.di: r.section for r in V.schema_sections(p, s, 20).collect()} == {1: full, 4: "city(id, name)\norders(id, price)"}
    hits = spark.createDataFrame([(1, "orders", "cities")], "di int, tbl string, term string")
    assert {(r.di, r.tbl): r.points for r in V.relevance(q, s, hits).collect()}[(1, "orders")] == 6
    assert V.schema_sections(p.limit(0), s).count() == 0


def test_texts(spark):
    t = spark.createDataFrame([("Select 'a;b' ; x",), ("plan: with c as (select 1) select \"p;q\" from c; done",), ("-- select 1;\nselect 2",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(T.fenced_sql(F.col("t"))).collect()] == ["Select 'a;b'", "with c as (select 1) select \"p;q\" from c", "select 2", None, ""]
    w = spark.createDataFrame([(x,) for x in ("songs", "song", "ss", "s", "bus")], "w string")
    assert [r[0] for r in w.select(T.token_variants(F.col("w"))).collect()] == [["songs", "song"], ["song", "songs"], ["ss"], ["s"], ["bus"]]
    assert spark.range(1).select(T.truncate(F.lit("  ab   cdefgh "), 6), T.norm_value(F.lit("3-D Man")), T.norm_value(F.lit(None)), T.norm_name(F.lit(" A-b "))).first() == ("ab ...", "3dman", "", "a_b")
    cut = spark.createDataFrame([("word " * 50,), ("short",), (None,)], "t string").select(T.truncate_prompt(F.col("t"), 10).alias("c")).collect()
    assert len(cut[0].c) <= 43 and cut[1].c == "short" and cut[2].c is None


def test_lines_and_examples(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(3000)))
    (tmp_path / "e.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r.line, r.text) for r in R.numbered_lines(spark, str(tmp_path / "a.txt")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, str(k)) for k in range(3000)] and R.numbered_lines(spark, str(tmp_path / "e.txt")).count() == 0
    recs = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"messages": []}', '{"question": "q", "candidates": [{"raw_response": " ", "execution_success": true, "correct_vav": true}, {"raw_response": "r", "execution_success": true, "correct_vav": false}, {"raw_response": "s", "execution_success": true, "correct_vav": true}]}', "broken", None, "{}"]
    df = spark.createDataFrame(list(enumerate(recs)), "idx int, record string")
    assert sorted((r.idx, r.response) for r in R.example_entries(df).collect()) == [(0, "a"), (2, "s")]
    c = spark.createDataFrame([("r", 1), ("r", 1), ("r", 2), ("r", None)], "run string, dataset_index int")
    assert R.checkpoint_faults(c.where("dataset_index is not null"), c.where("dataset_index = 1")).first()[1:] == (1, 1, 1, 0)


def test_sample_rows_and_assembly(spark):
    points = spark.createDataFrame([(1, "d", "a", 0), (1, "d", "b", 5), (2, "d", "a", 0), (2, "d", "b", 0)] + [(3, "e", f"t{k}", k % 3) for k in range(8)], "di int, db_id string, tbl string, points int")
    rows = spark.createDataFrame([("d", t, k, f"{t * 20}{k}") for t in "ab" for k in (1, 2, 3)] + [("e", f"t{k}", 1, "x") for k in range(8)], "db_id string, tbl string, place int, value string")
    got = {r.di: r.section.split("\n") for r in V.sample_sections(points, rows, 60).collect()}
    # A line has 26 characters: two of the first table fit, its third ends it, and no line of the second fits any more.
    assert got[1] == ["b #1: " + "b" * 20 + "1", "b #2: " + "b" * 20 + "2"] and got[2] == ["a #1: " + "a" * 20 + "1", "a #2: " + "a" * 20 + "2"]
    assert [x.split()[0] for x in got[3]] == ["t2", "t5", "t1", "t4"]
    t = spark.createDataFrame([("aaaa", "bbbb", "cc"), ("", None, "cc"), ("a" * 50, "b", "c"), (None, "", "")], "a string, b string, c string")
    out = [r[0] for r in t.select(V.assembled([("A", F.col("a")), ("B", F.col("b")), ("C", F.col("c"))], 20)).collect()]
    assert out == ["[A]\naaaa\n\n[B]\nbbbb", "[C]\ncc", "[A]\n" + "a" * 13, ""]
    assert V.sample_sections(points.limit(0), rows).count() == 0
