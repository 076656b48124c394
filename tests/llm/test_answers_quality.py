"""Truncation, pair defects and text quality on hand-made cases and against brute force."""

import random

import numpy as np
import pytest

from quorumframe.llm import quality as Q
from quorumframe.llm import truncation as T
from quorumframe.llm.answers import SuffixAutomaton, language, query_state, read_answer
from quorumframe.llm.pairs import defect, defective_pairs

ASK = "List the street of every bakery whose daily loaves is no more than 6758."
SQL = "SELECT street FROM bakery WHERE daily_loaves <= 6758"


@pytest.mark.parametrize("partitions", [1, 3, 20])
def test_strict_prefixes(spark, partitions):
    rnd = random.Random(partitions)
    short = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 7))) for _ in range(150)] + [None, "ü", "zz"]
    long = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9))) for _ in range(60)] + [None, "üx", "zz"]
    want = {s for s in short if s and any(x is not None and x != s and x.startswith(s) for x in long)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "value string")
    got = [r.value for r in T.strict_prefixes(frame(short), frame(long), spark, partitions).collect()]
    assert sorted(got) == sorted(want)
    assert T.strict_prefixes(frame(short[:0]), frame(long), spark).count() == 0


@pytest.mark.parametrize(("sql", "state"), [
    (SQL, "open"), (SQL + ";", "whole"), ("SELECT a", "cut"), ("SELECT a FROM", "cut"), ("SELECT a, FROM t", "cut"), ("SELECT a FROM t WHERE", "cut"), ("SELECT a FROM t WHERE b", "cut"), ("SELECT a FROM t WHERE b =", "cut"),
    ("SELECT a FROM t WHERE b BETWEEN 1 AND", "cut"), ("SELECT a FROM t WHERE b BETWEEN 1 AND 2", "open"), ("SELECT a FROM t WHERE b IN (1, 2", "cut"), ("SELECT a FROM t WHERE b IN (SELECT c FROM", "cut"), ("SELECT a FROM t WHERE b LIKE '%x", "cut"),
    ("SELECT a FROM t GROUP BY", "cut"), ("SELECT a FROM t ORDER BY a DESC LIMIT", "cut"), ("SELECT a FROM t ORDER BY a DESC LIMIT 3", "open"), ("SELECT a FROM t JOIN u", "cut"), ("SELECT a FROM t JOIN u ON t.x = u.x", "open"), ("SELECT a FROM t WHERE b IS NOT", "cut"), ("SELECT a FROM t WHERE b IS NOT NULL AND (c = 1 OR d LIKE 'x')", "open"),
])
def test_query_state(sql, state):
    assert query_state(sql) == state


@pytest.mark.parametrize(("raw", "sql", "kind"), [
    (f"```sql\n{SQL}\n```", SQL, ""), (f"```sql\n{SQL}", "", "truncated"), (f"Sure.\n<answer>{SQL}</answer>\n\nThis returns one row per match.", SQL, ""), (f"Sure.\n<answer>{SQL}</answer>\n\nThis returns one row per ma", SQL, "truncated"),
    (SQL, SQL, ""), (SQL[:-7], SQL, "truncated"), ("Let me think about the tables. The bakery table hol", None, "truncated"), ("The bakery table holds the col...", None, "truncated"), ("The bakery table holds the col\\u00", None, "truncated"),
    (ASK, None, "copy"), (f"> {ASK.upper()}", None, "copy"), (f"Q: {ASK}\nA: {ASK}", "", "copy"), (f"```sql\n-- {ASK}\n```", None, "copy"), (ASK.rstrip("."), None, "copy"), (f"{ASK}\n\n{SQL}", SQL, ""), (ASK[:40], None, "truncated"),
    ("I'm sorry, but I can't help with this request.", "", "refusal"), (f"I'm sorry for the slow start.\n```sql\n{SQL}\n```", SQL, ""), ("```sql\n-- unable to comply: salt is off limits\n```", None, "refusal"), ("抱歉，我无法回答这个问题。", None, "refusal"),
    (None, None, "empty"), ("```sql\n```", " ", "empty"), ("<think>\n\n</think>\n", "", "empty"), ("​", None, "empty"), ("N/A", "null", "empty"), ("  ", "", "empty"), ("", SQL, ""),
    (f"Zuerst prüfe ich, welche Tabellen gebraucht werden. Die Tabelle bakery enthält die Spalte street, die der Filter braucht.\n```sql\n{SQL}\n```", SQL, "other_language"), (f"Well, ok. {SQL};", SQL, ""),
    ("x" * 200_000, None, "truncated"),
])
def test_defects(raw, sql, kind):
    assert defect(ASK, raw, sql) == kind


def test_pairs_on_spark(spark):
    lead = "The bakery table holds the column street, which the filter needs."
    rows = [(k, ASK, f"{lead}\n```sql\n{SQL}\n```", SQL, "a") for k in range(20)]
    rows += [(30, ASK, lead[:35], None, "a"), (31, ASK, None, None, None), (32, None, ASK, SQL, "b"), (33, ASK, ASK, "", "b"), (None, ASK, "", "", "b"), (30, ASK, lead[:35], None, "a"), (34, ASK, f"{lead}\n```sql\nSELECT str", "", None)]
    df = spark.createDataFrame(rows, "response_id long, question string, raw_response string, sql string, source string").withColumnRenamed("source", "source").selectExpr("*", "1 as value", "2 as cut")
    assert sorted(tuple(r) for r in defective_pairs(df, spark).collect()) == [(30, "truncated"), (31, "empty"), (32, "truncated"), (33, "copy"), (34, "truncated")] or sorted(tuple(r) for r in defective_pairs(df, spark).collect()) == [(30, "truncated"), (31, "empty"), (33, "copy"), (34, "truncated")]
    cut = T.cut_off(df, spark)
    share = {r.source: (r.n_responses, r.n_cut) for r in T.share_by_source(df, cut).collect()}
    assert share["a"] == (21, 1) and share[None] == (2, 1)
    assert defective_pairs(df.limit(0), spark).count() == 0


def test_suffix_automaton():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choice("abc") for _ in range(n)) for n in (12, 15))
        machine = SuffixAutomaton(a)
        share, given = machine.coverage(b, 3)
        hit, back = [False] * len(b), [False] * len(a)
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                k = a.find(b[i:j])
                if k >= 0 and j - i >= 3:
                    hit[i:j] = [True] * (j - i)
        for _, state, size in machine.walk(b):
            if size >= 3:
                k = machine.first[state] - size
                assert a[k : k + size] in b
                back[k : k + size] = [True] * size
        assert abs(share - sum(hit) / len(b)) < 1e-9 and abs(given - sum(back) / len(a)) < 1e-9


def test_copies_are_told_by_coverage():
    typo = ASK.replace("street", "streat")
    assert defect(ASK, typo, None) == "copy" and ASK not in typo  # no containment: only the copied share tells
    assert defect(ASK, "\n".join([ASK, ASK, typo, ASK, ASK]), None) == "copy"  # however often
    assert defect(ASK, ASK[: len(ASK) // 2], None) == "truncated"  # all copied, but not all given back
    assert defect(ASK, f"{ASK} The bakery table is read once, and its rows are kept in their order.", None) == "truncated"  # half of it is new


def test_one_defect_each(spark):
    rows = [(1, ASK, "I'm sorry, but I can't help with...", None), (2, ASK, "SELECT street FROM bakery", None), (3, ASK, SQL, SQL), (4, ASK, "Die Tabelle wird mit der Spalte für den Filter und nicht mit dem Namen gelesen.\nSELECT street FROM bakery", None)]
    df = spark.createDataFrame(rows, "response_id long, question string, raw_response string, sql string")
    assert sorted(tuple(r) for r in defective_pairs(df, spark).collect()) == [(1, "refusal"), (2, "truncated"), (4, "other_language")]
    s = {r.response_id: (r.by_structure, r.by_prefix) for r in T.signals(df, spark).collect()}
    assert s == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}


def test_language():
    assert language("The table holds the column that we need for this.")[0] == "en" and language("按 street 分组后每个取值对应一行结果。")[0] == "zh"
    assert language("La table contient la colonne dont le filtre a besoin.")[0] == "fr" and language("xyz 12")[0] == ""
    assert read_answer(None).ends == "empty"


PROSE = "The order check improves every second vote, and nobody noticed it. It is not clear whether the gain survives a different seed."
KINDS = [
    (PROSE, "prose"), (PROSE.replace(".", "").replace(",", ""), "prose"), (PROSE + "\n- one\n- two\n- three", "prose"), (PROSE + "\n| a | b |\n|---|---|\n| 1 | 2 |", "prose"), ("软投票重复了一部分嵌套查询，直到超时被放宽。这些数字只来自开发集，不能与训练集混用。", "prose"), ("软投票重复了一部分嵌套查询直到超时被放宽这些数字只来自开发集不能与训练集混用", "prose"),
    ("Leere Ergebnisse dürfen nicht gegen gefüllte gewinnen. Das Protokoll zeigt, dass 1163 Abfragen vorher abgebrochen wurden.", "prose"),
    ("- rename width\n- check spelling\n- step 23\n- votes of Bela", "list"), ("a: on\nb: off\nc: 12\nd: off", "list"), ("step 1; votes of Bela; rename x; check y; meadow", "list"), ("1. 检查 age\n2. 种子 12\n3. 第 4 步", "list"),
    ("a,b,c\n1,x,2.5\n2,y,3.5\n3,z,4.5", "table"), ("| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n| 3 | z |", "table"), ("id      name    v\n1       Bela    2\n2       Cora    3\n3       Dora    4", "table"), ("1\tx\t2\n2\ty\t3\n3\tz\t4", "table"),
    ("nan " * 40, "junk"), ("00000000  4a 08 4b e9 ec c7 95 4c\n00000010  1d b5 64 63 67 70 79 f4", "junk"), ("Rtsb49TNuHswRyCW8EwEnjelr627yfxcJdHwWehO4yvkxWcpH9PBs//jTJt4R8T2lctBbybk1J/I", "junk"), ('<div class="c71"><span id=x602></span></div>' * 5, "junk"),
    ("[0.1234,-0.5321,1.2345,0.3333]", "junk"), ("~*~ _=~_==~\n*#* ==~*=#*-=--- --** #~=~#-_", "junk"), ("kqaj ddppkof rdfat tdui opkpp upit padal pdzp slfjrjd ekfr ukd zuuw elok eqpq", "junk"), ("The vote was kept. " * 12, "junk"),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    assert Q.kind_of(text) == kind


def test_divergence_decides_the_kind(monkeypatch):
    """Without the divergence of a line from the profiles, all lines take one form, and other kinds come out."""
    monkeypatch.setattr(Q, "divergences", lambda lines, against, blocks=None: np.zeros((len(lines), len(against))))
    assert {k for t, k in KINDS if Q.kind_of(t) != k} == {"list", "junk"} and sum(Q.kind_of(t) != k for t, k in KINDS) == 5
    monkeypatch.undo()
    # Each of the three distributions is needed by itself.
    for k in range(3):
        monkeypatch.setattr(Q, "BLOCK_WEIGHTS", tuple(0.0 if i != k else 1.0 for i in range(3)))
        monkeypatch.setattr(Q.divergences, "__defaults__", (Q.BLOCK_WEIGHTS,))
        assert any(Q.kind_of(t) != kind for t, kind in KINDS), k


def test_divergence_against_the_formula():
    rnd = np.random.default_rng(5)
    p, q = (np.concatenate([rnd.dirichlet(np.ones(n), 4) for n in Q.SIZES], axis=1) for _ in range(2))
    at = np.cumsum([0, *Q.SIZES])
    want = [[sum(w * Q.divergence(a[i:j], b[i:j]) for w, i, j in zip(Q.BLOCK_WEIGHTS, at, at[1:])) for b in q] for a in p]
    assert np.allclose(Q.divergences(p, q), want)


def test_repeats_in_linear_time():
    import time

    brute = lambda s: len(s) >= 24 and any(s[p:] == s[:-p] for p in range(1, len(s) // 4 + 1))
    rnd = random.Random(2)
    for _ in range(400):
        unit = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9)))
        s = (unit * 20)[: rnd.randint(20, 60)] + rnd.choice(["", "", "a", "b"])
        assert Q.periodic(s) == brute(s), s
    began = time.time()
    assert not Q.periodic("a" * 10_000_000 + "b") and time.time() - began < 5


def test_quality_on_spark(spark):
    rows = [(k, t, "x") for k, (t, _) in enumerate(KINDS)] + [(90, None, "x"), (91, " ​\n", "x"), (None, "abc", "x"), (92, "word " * 100_000, "x"), (93, ".", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r.kind for r in Q.text_quality(df).collect()}
    assert {k: got[k] for k in range(len(KINDS))} == {k: kind for k, (_, kind) in enumerate(KINDS)} and got[92] == "junk" and not {90, 91, None} & set(got)
    assert Q.text_quality(df.limit(0)).count() == 0
    assert Q.divergence((1.0, 0.0), (0.0, 1.0)) == 1.0 and Q.divergence((0.5, 0.5), (0.5, 0.5)) == 0.0


def test_open_queries_by_longer_copies(spark):
    rows = [
        (1, ASK, "SELECT street FROM bakery", None), (2, ASK, SQL, SQL),  # cut between two clauses, and its longer copy
        (3, "other", "SELECT street FROM bakery", None),  # whole: the longer copy answers another question
        (4, "whole", "SELECT street FROM bakery", None), (5, "whole", "SELECT street FROM bakery;\n\nThis returns each street.", None),  # the same query
        (6, ASK, "SELECT street FROM bakery", "SELECT street FROM bakery"),  # whole: its sql says so
        (7, "one", "The", None), (8, "two", "SELECT", None), (9, "three", "Nothing goes on like this end in any oth", None), (10, None, ASK, SQL),
    ]
    df = spark.createDataFrame(rows, "response_id long, question string, raw_response string, sql string")
    assert sorted(r.response_id for r in T.cut_off(df, spark).collect()) == [1, 7, 8, 9, 10]


def test_pairs_have_one_defined_result(spark):
    rows = [(30, ASK, "The bakery table holds the column st", None), (32, None, ASK, SQL), (33, ASK, ASK, ""), (34, ASK, SQL, SQL)]
    df = spark.createDataFrame(rows, "response_id long, question string, raw_response string, sql string")
    assert sorted(tuple(r) for r in defective_pairs(df, spark).collect()) == [(30, "truncated"), (32, "truncated"), (33, "copy")]
