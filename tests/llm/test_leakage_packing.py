"""FM-index and leak search against brute force; packing by its invariants."""

import random

import numpy as np
import pytest

from quorumframe.llm import leakage as L
from quorumframe.llm import packing as K
from quorumframe.llm.fmindex import FMIndex, suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    rnd = np.random.default_rng(seed)
    text = rnd.integers(1, 4 if seed % 2 else 60, 500)
    full = [*text.tolist(), 0]
    assert suffix_array(np.array(full)).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    index = FMIndex(text, 60)
    pats = np.array([text[i : i + 3] for i in rnd.integers(0, 497, 30)] + [[59, 59, 58]])
    lo, hi = index.search(pats)
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(498) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        w = L.words(t)
        runs = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, x in items:
            v = L.words(x or "")
            if any(tuple(v[k : k + run]) in runs for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [20, 10_000])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_WORDS", shard)
    monkeypatch.setattr(L, "BLOCK_WORDS", 60)
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(25))) for k in range(8)] + [(90, "too short"), (91, None), (92, ""), (93, None)]
    items.append((94, items[0][1]))
    docs = []
    for d in range(60):
        w = [rnd.choice([*vocab, "other", "else"]) for _ in range(rnd.randrange(40))]
        if d % 3 == 0:
            src = L.words(items[rnd.randrange(8)][1])
            n = rnd.choice([4, 5, 6, 20])
            a = rnd.randrange(len(src) - n)
            w[5:5] = src[a : a + n]
        docs.append((d, rnd.choice([" ", "\n", ", ", "  **"]).join(x.upper() if rnd.random() < 0.2 else x for x in w)))
    docs += [(70, None), (71, ""), (72, "ü, 中文 。"), (None, "w1"), docs[0], (73, " ".join(["w1 w2 w3"] * 5000))]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, item_text string, doc_id string")
    got = L.leaked_spans(df, it, spark, run=5).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 5)
    text = dict(docs)
    for r in got:
        assert r.last_word - r.first_word + 1 >= 5 and r.last_word < len(L.words(text[r.doc_id]))
    assert L.leaked_spans(df.limit(0), it, spark).count() == 0 and L.leaked_spans(df, it.limit(0), spark).count() == 0


def test_spans_merge():
    assert L.merge_spans([0, 1, 5, 30], 12) == [(0, 16), (30, 41)]


def test_hilbert_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = K.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rnd = random.Random(4)
    docs = [(k, rnd.choice(["a ", "ä", "中", "😀x"]) * rnd.randrange(1, 400)) for k in range(300)] + [(400, None), (401, ""), (402, " "), (403, "z" * 5000), (404, "中" * 3000)]
    docs += [docs[0], (None, "q")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, capacity int")
    win = spark.createDataFrame([(1, 100, "x"), (2, 1000, "y"), (1, 100, "x"), (3, None, "z")], "window_id int, capacity_tokens int, doc_id string")
    rows = K.pack(df, win, spark).collect()
    text, used = dict(docs), {}
    for r in rows:
        data = text[r.doc_id].encode()
        part = data[r.first_byte : r.last_byte]
        part.decode()
        assert r.tokens == len(part) + 1 <= r.capacity and (r.n_pieces > 1) == (len(data) + 1 > r.capacity)
        used[(r.window_id, r.container)] = used.get((r.window_id, r.container), 0) + r.tokens
    assert all(v <= {1: 100, 2: 1000}[w] for (w, _), v in used.items())
    for w in (1, 2):
        for d in text:
            if d is not None and text[d] and d != 0:
                ps = sorted((r.piece, r.first_byte, r.last_byte) for r in rows if r.window_id == w and r.doc_id == d)
                assert [p[0] for p in ps] == list(range(len(ps))) and ps[0][1] == 0 and ps[-1][2] == len(text[d].encode()) and all(a[2] == b[1] for a, b in zip(ps, ps[1:]))
    waste = {r.window_id: r.unused for r in K.fill_report(K.pack(df, win, spark)).collect()}
    assert waste[2] < 0.15
    assert not {400, 401, None} & {r.doc_id for r in rows} and 402 in {r.doc_id for r in rows}
    assert K.pack(df.limit(0), win, spark).count() == 0 and K.pack(df, win.limit(0), spark).count() == 0
