import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm import toxicity as T


def slow(scores):
    """Maximal segments by their definition: split at the best one, then on either side."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
    a, b = best[3], best[4]
    return [*slow(scores[:a]), (a, b), *[(x + b, y + b) for x, y in slow(scores[b:])]]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 24), st.sampled_from([1.03, 2.17, 3.31, -1.43, -0.71]), max_size=8))
def test_segments_against_the_definition(marks):
    places = sorted(marks)
    full = [-0.1] * 25
    for p in places:
        full[p] = marks[p]
    got = T.maximal_segments(places, [marks[p] for p in places], 0.1)
    assert [(a, b) for a, b, _ in got] == slow(full)
    assert all(abs(s - sum(full[a:b])) < 1e-6 for a, b, s in got)


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in T.op5_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    rank = np.argsort(np.argsort([r.score for r in rows])) + 1
    y = np.array([labels[r.doc_id] for r in rows])
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    found = np.array([r.predicted for r in rows])
    assert auc > 0.9 and found[y == 1].mean() > 0.75 and found[y == 0].mean() < 0.01


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (6, 0, "x"), (6, None, "x"), (None, 1, "x"), (9, 0, "x")], "doc_id bigint, toxic int, text string")
    model = T.fit(T.training_rows(odd, labels))
    got = T.score(odd, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    empty = T.fit(T.training_rows(nothing, labels))
    assert {r.predicted for r in T.score(odd, empty).collect()} == {0}
    assert T.score(nothing, model).count() == 0


def test_labels_of_the_held_out_fifth_are_not_learned(spark):
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, "bad words here") for i in range(400)], "doc_id bigint, text string")
    assert T.training_rows(docs, labels).count() == 0


def test_fit_against_plain_counts(spark):
    """Words, their log-odds and the drift, by counting in Python."""
    import math

    from seamark.llm import kernels

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = T.training_rows(docs, labels)
    model = T.fit(rows)
    part = {r.doc_id: r.p for r in rows.selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 10) as p").collect()}
    toxic, clean = {}, {}
    for r in rows.collect():
        if part[r.doc_id] < 7:
            for w in set(kernels.words(__import__("pyarrow").array([r.text]))[0].tolist()):
                side = toxic if r.toxic else clean
                side[w] = side.get(w, 0) + 1
    n1, n0 = sum(toxic.values()), sum(clean.values())
    want = {}
    for w in {*toxic, *clean}:
        a, b = toxic.get(w, 0), clean.get(w, 0)
        prior = T.PRIOR * (a + b)
        odds = lambda y, n: math.log((y + prior) / (n * (1 + T.PRIOR) - y - prior))  # noqa: B023, E731
        delta = odds(a, n1) - odds(b, n0)
        if abs(delta / math.sqrt(1 / (a + prior) + 1 / (b + prior))) >= T.MIN_Z and abs(delta) >= T.MIN_ODDS:
            want[w] = delta
    got = dict(zip(model.words.values.tolist(), model.weights.tolist(), strict=True))
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    drift = max(T.DRIFT, 2 * sum((clean.get(w, 0) + 0.5) / (n0 + 1) * x for w, x in want.items()))
    assert abs(model.drift - drift) < 1e-9


def test_one_text_an_id_is_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert sorted((r.doc_id, r.toxic) for r in T.training_rows(docs, labels).collect()) in ([(1, 1), (2, 0)], [(1, 1)], [(2, 0)], [])
