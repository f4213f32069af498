import math

import pytest

from seamark.functions.text import in_scope  # noqa: F401
from seamark.operators import evaluate, search


def test_bm25_and_fusion_against_a_loop(spark):
    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: "alpha alpha alpha alpha x1"}
    cos = {1: 0.1, 2: 0.9, 3: 0.5, 4: 0.5}
    cands = spark.createDataFrame([(0, i, t, cos[i]) for i, t in docs.items()], "qid bigint, vector_id bigint, content string, cos double")
    queries = spark.createDataFrame([(0, "Alpha beta alpha zeta")], "qid bigint, text string")
    got = {r.vector_id: r for r in search.fused(cands, queries).collect()}
    n, avg = 4, sum(len(t.split()) for t in docs.values()) / 4
    want = {}
    for i, t in docs.items():
        words, s = t.split(), 0.0
        for term in ("alpha", "beta", "zeta"):
            df, tf = sum(term in x.split() for x in docs.values()), words.count(term)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        want[i] = s
        assert math.isclose(got[i].bm25, s, abs_tol=1e-8)
    sem = sorted(docs, key=lambda i: (-cos[i], i))
    lex = sorted(docs, key=lambda i: (-round(want[i], 9), sem.index(i)))
    score = {i: 1 / (60 + sem.index(i)) + 1 / (60 + lex.index(i)) for i in docs}
    assert [i for i in sorted(docs, key=lambda i: got[i].ord)] == sorted(docs, key=lambda i: (-round(score[i], 12), sem.index(i)))


def test_stable_ranks_and_vector_only(spark):
    cands = spark.createDataFrame([(0, 1, "x", 0.2), (0, 2, "y", 0.9)], "qid bigint, vector_id bigint, content string, cos double")
    queries = spark.createDataFrame([(0, "::")], "qid bigint, text string")
    got = search.fused(cands, queries).orderBy("ord").collect()
    assert [(r.vector_id, r.score) for r in got] == [(2, 0.9), (1, 0.2)]


def test_rerank_keeps_the_tail(spark):
    rows = [(0, i, "match" if i == 3 else "other", 1.0 - i / 10, i) for i in range(5)]
    ordered = spark.createDataFrame(rows, "qid bigint, vector_id bigint, content string, score double, ord int")
    queries = spark.createDataFrame([(0, "match")], "qid bigint, text string")
    again = search.reranked(ordered, queries, search.term_overlap, top=4).orderBy("ord").collect()
    assert [r.vector_id for r in again] == [3, 0, 1, 2, 4] and again[4].score == 0.6


def test_parent_is_the_smallest_span(spark):
    rows = [("f", 0, 1, 0, 100), ("f", 1, 2, 10, 80), ("f", 2, 3, 20, 30), ("g", 0, 4, 0, 5)]
    chunks = spark.createDataFrame(rows, "file_path string, chunk_index int, vector_id bigint, start_byte bigint, end_byte bigint")
    assert {r.vector_id: r.parent_id for r in search.parents(chunks).collect()} == {2: 1, 3: 2}


def test_parents_against_all_pairs(spark):
    import random

    r, rows = random.Random(5), []
    for f in range(30):
        for k in range(r.randrange(1, 25)):
            a = r.randrange(0, 30)
            rows.append((f"f{f}", k, 1000 * f + k, a, a + r.randrange(1, 30)))
    want = {}
    for f, _, v, a, b in rows:
        around = [(y - x, k2, v2) for f2, k2, v2, x, y in rows if f2 == f and v2 != v and x <= a and y >= b]
        if around:
            want[v] = min(around)[2]
    chunks = spark.createDataFrame(rows, "file_path string, chunk_index int, vector_id bigint, start_byte bigint, end_byte bigint")
    assert {x.vector_id: x.parent_id for x in search.parents(chunks).collect()} == want


def test_knn_and_ranks_in_tiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "TILE", 7)
    monkeypatch.setattr(evaluate, "TILE", 7)
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.integers(-2, 3, (200, 4)).astype(float)  # many ties
    q = rng.integers(-2, 3, (17, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vector_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid bigint, vector array<float>")
    cos = np.round(q @ x.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-12), 9)
    order = [sorted(range(200), key=lambda i, k=k: (-cos[k, i], i)) for k in range(17)]
    got = {}
    for r in search.knn_batch(vectors, queries, 12).collect():
        got.setdefault(r.qid, set()).add(r.vector_id)
    assert got == {k: set(o[:12]) for k, o in enumerate(order)}
    gold = spark.createDataFrame([(k, 5 * k if k else 5000) for k in range(17)], "qid bigint, vector_id bigint")
    ranks = {r.qid: r["rank"] for r in evaluate.gold_ranks(vectors, queries, gold).collect()}
    assert ranks == {0: 202, **{k: order[k].index(5 * k) + 1 for k in range(1, 17)}}


@pytest.mark.parametrize(("limit", "want"), [(None, 10), (0, 1), (99, 50), (7, 7)])
def test_limits(limit, want):
    assert search.server_limit(limit) == want


def test_budget():
    assert (search.budget(10, False, False), search.budget(10, True, False), search.budget(20, False, True)) == (10, 400, 800)


def test_knn_edges(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vector_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "qid bigint, vector array<float>")
    assert [(r.vector_id, r.cos) for r in search.knn_batch(vectors, queries, 3).orderBy("vector_id").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert search.knn_batch(vectors, queries.where("qid > 5"), 3).count() == 0


def test_metrics(spark):
    ranks = spark.createDataFrame([(1,), (2,), (11,), (None,)], "rank bigint")
    r = evaluate.metrics(ranks).first()
    assert (r.n, r.mrr_10, r.recall_1, r.recall_5) == (4, 0.375, 0.25, 0.5)
    assert r.ndcg_10 == round((1 + 1 / math.log2(3)) / 4, 4)


def test_rerank_ranks(spark):
    ranks = spark.createDataFrame([(0, 2), (1, 9)], "qid bigint, rank bigint")
    scores = spark.createDataFrame([(0, 0, False, 0.1), (0, 1, True, 0.5), (1, 0, False, 0.9)], "qid bigint, ord int, gold boolean, score double")
    assert {r.qid: r.rank for r in evaluate.rerank_ranks(ranks, scores, 2).collect()} == {0: 1, 1: 9}
