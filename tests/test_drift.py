"""Schema drift against a plain scan of whole series, and its defined cases."""

import datetime
import json

import pytest

from quorumframe.operators import drift

SCHEMA = "file_id long, series_id long, written_at timestamp, payload string, note string"


def t(k):
    return datetime.datetime(2031, 1, 1) + datetime.timedelta(hours=k)


def plain(rows):
    """All series, one after another, with the step function alone."""
    out, state, series, last = [], None, None, None
    for f, s, w, p in sorted((r[:4] for r in rows if None not in r[:4]), key=lambda r: (str(r[1]), r[2], r[0])):
        rec = drift.parse(p)
        if rec is None or f == last:
            continue
        last = f
        fields = {k: drift.tag(v) for k, v in drift.flatten(rec)}
        if s != series:
            series, state = s, fields
            continue
        changes, state, open_ = drift.step(state, fields, f)
        assert not open_
        out += changes
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 2, 5, 30])
def test_partitioning_does_not_matter(spark, partitions):
    import random

    rnd = random.Random(3)
    rows, fid = [], 0
    names = ["match_rate", "matchRate", "elapsed_seconds", "wall_seconds", "lora", "lora_name", "seed", "note"]
    for s in range(4):
        for k in range(120 if s == 0 else 6):
            fid += 1
            rec = {n: rnd.choice([None, None, 1, 1.5, "x", True, [1]]) for n in rnd.sample(names, 4)}
            rec["config"] = {rnd.choice(["workers", "exec_workers"]): rnd.choice([None, 3])}
            rows.append((fid, s, t(k), json.dumps(rec), "x"))
            if fid % 7 == 0:
                rows.append((fid, s, t(k), json.dumps(rec, indent=2), "y"))
    got = drift.schema_changes(spark.createDataFrame(rows, SCHEMA), spark, partitions=partitions)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_kinds_of_change(spark):
    p = [{"a_name": 1, "b": None, "c": {"d": 1}}, {"a_id": 2, "b": "x", "c": {"d": 1.5, "e": None}}, {"b": None, "c": {"d": "1", "e": True}}, {"b": 3, "c": {"d": None, "e": 1}}]
    rows = [(k, 1, t(k), "﻿" + json.dumps(r), None) for k, r in enumerate(p)] + [(9, None, t(1), "{}", None), (10, 1, t(9), "broken", None), (11, 2, t(0), None, None)]
    got = {tuple(r) for r in drift.schema_changes(spark.createDataFrame(rows, SCHEMA), spark, partitions=3).collect()}
    assert got == {(1, "renamed", "a_name", "a_id"), (1, "added", "", "c.e"), (2, "removed", "a_id", ""), (2, "type_changed", "c.d", "c.d"), (3, "type_changed", "b", "b"), (3, "type_changed", "c.e", "c.e")}


def test_names_alike():
    same = [("match_rate", "exec_match_rate"), ("model", "modelId"), ("elapsed_seconds", "wall_seconds"), ("config.max_new_tokens", "config.new_tokens"), ("n_prompts", "num_prompts")]
    other = [("match_rate", "match_count"), ("parse_count", "parse_success_rate"), ("total_requested", "total_completed"), ("workers", "config.workers"), ("avg_confidence", "match_rate")]
    assert all(drift.likeness(a, b) > 0 for a, b in same) and not any(drift.likeness(a, b) for a, b in other)


def test_empty_and_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(none, spark).count() == 0
    files = spark.createDataFrame([(1, 1, t(0), '{"a": "76.5%", "b": [3], "c": {"d": null}}', "n"), (2, 1, t(1), "x", None)], SCHEMA)
    rows = {(r.path, r.type, r.canonical) for r in drift.unified_table(files, order="written_at").collect()}
    assert rows == {("a", "string", "0.765"), ("b", "list", "3"), ("c.d", "null", None)}
    assert drift.unified_table(none, order="written_at").count() == 0
