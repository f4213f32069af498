from collections import Counter

import numpy as np

from seamark.llm import graph, kernels
from seamark.llm import jaccard_join as J


def brute(rows):
    """doc_id -> number of similar documents, and its group, by comparing all pairs."""
    sets = {i: frozenset(kernels.of_text(t or "").tolist()) for i, t in rows}
    up, links = {i: i for i in sets}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in ids}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_links, r.group_id) for r in J.jaccard_join(docs).collect()} == want


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "EXACT_BLOCK", 16)
    monkeypatch.setattr(J, "LEAF", 2)
    monkeypatch.setattr(graph, "HOT", 8)
    rng = np.random.Generator(np.random.PCG64(4))
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 4)), replace=False):
            words[at] = f"n{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(60))) for i in range(20)]
    got = {r.doc_id: (r.n_links, r.group_id) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, odd, nothing):
    got = J.jaccard_join(odd).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].class_id == by[5].class_id == 1 and by[1].class_docs == 3 and by[5].n_links == 2 and by[1].group_id == 1
    assert all(by[i].n_links == 0 and by[i].group_id == i for i in (2, 3, 4, 6, 7, 8, 9))
    assert all(r.n_links == 0 and r.group_id is None for r in got if r.doc_id is None)
    assert J.jaccard_join(nothing).count() == 0


def test_depth_meets_the_target():
    d = J.depth_for()
    assert J.recall(d, J.THRESHOLD) >= J.TARGET > J.recall(d + 1, J.THRESHOLD) and J.SHORTEST < d < J.DEPTH


def test_leaves_against_a_walk(spark, monkeypatch):
    """The tries' leaves, by splitting sorted labels; labels of few values, so that nodes are crowded."""
    monkeypatch.setattr(J, "LEAF", 4)
    rng = np.random.Generator(np.random.PCG64(12))
    labels = rng.choice([1, 2, 200], (300, J.TREES, J.DEPTH), p=[0.6, 0.3, 0.1]).astype(np.uint8)
    values = labels.reshape(300, -1).view(">i8").astype(np.int64)
    rows = [(k, *(int(x) for x in v)) for k, v in enumerate(values)]
    classes = spark.createDataFrame(rows, "node bigint, " + ", ".join(f"{x} bigint" for x in J._L))
    longest, want = 5, set()

    def split(tree, members, depth):
        by = {}
        for m in sorted(members, key=lambda m: bytes(labels[m, tree])):
            by.setdefault(bytes(labels[m, tree, :depth]), []).append(m)
        for group in by.values():
            if len(group) > 1 and (len(group) <= J.LEAF or depth == longest):
                want.add((frozenset(group), len(group), depth, tree))
            elif len(group) > 1:
                split(tree, group, depth + 1)

    for tree in range(J.TREES):
        split(tree, range(300), J.SHORTEST)
    got = {}
    for r in J.leaves(classes, longest).collect():
        got.setdefault(r.key, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g, *_ in want) and len({d for _, _, d, _ in want}) == 3


def test_recall_just_above_the_threshold(spark):
    """Hundreds of pairs of 0.78 to 0.85: the links are those of all pairs."""
    rng = np.random.Generator(np.random.PCG64(15))
    rows = []
    for i in range(400):
        n = int(rng.integers(60, 200))
        words = [f"v{i}x{k}" for k in range(n)]
        share = rng.uniform(0.78, 0.85)
        other, changed = list(words), 0
        while changed * J.kernels.SHINGLE < (1 - share) / (1 + share) * n - 2:  # each far change costs five shingles
            other[int((changed + 0.5) * 2 * J.kernels.SHINGLE) % n] = f"c{i}x{changed}"
            changed += 1
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute_pairs(rows)
    got = {r.doc_id: (r.n_links, r.group_id) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = [i for i, (k, _) in want.items() if k]
    assert len(linked) > 200 and len(linked) < len(want)
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked) and all(got[i] == want[i] for i in want if i not in linked)


def brute_pairs(rows):
    """As ``brute`` where only the texts 2i and 2i + 1 can be similar."""
    sets = {i: frozenset(kernels.of_text(t).tolist()) for i, t in rows}
    out = {}
    for i in sets:
        a, b = sets[i], sets[i ^ 1]
        linked = len(a & b) >= 0.8 * len(a | b) - 1e-9
        out[i] = (int(linked), i & ~1 if linked else i)
    return out


def test_one_id_with_many_texts(spark):
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join([*base[:40], f"n{k}", *base[41:]]) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (1, "something else that stands for itself alone")]
    got = sorted((r.doc_id, r.n_links, r.class_links) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 0, 0), (1, 4, 3), (1, 4, 3), (1, 4, 3), (2, 4, 3), (3, 4, 3)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), *((100 + i, 101 + i) for i in range(40)), *((50, 200 + i) for i in range(30))]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys((5, 6, 7, 8, 9), 5), **dict.fromkeys(range(100, 141), 100), 50: 50, **dict.fromkeys(range(200, 230), 50)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
