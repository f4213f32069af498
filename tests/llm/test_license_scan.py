import numpy as np

from seamark.llm import kernels
from seamark.llm import license_scan as L


def brute(text):
    """Every run of every template's length and a quarter, at each place, by exact containment; and the passages."""
    shingle, out = kernels.of_text(text), {}
    for name, template in L.TEMPLATES.items():
        ordered = kernels.of_text(template)
        want, run = set(ordered.tolist()), L.run_of(len(ordered))
        spans, best = [], 0
        for i in range(len(shingle)):
            at = [k for k in range(i, min(i + run, len(shingle))) if int(shingle[k]) in want]
            share = len({int(shingle[k]) for k in at}) / len(want)
            best = max(best, share)
            if share >= L.LEAST - 1e-9:
                spans.append((at[0], at[-1] + 1))
        if spans:
            n, last = 0, -1
            for a, z in sorted(spans):
                n += a >= last
                last = max(last, z)
            out[name] = (best, n)
    return out


def test_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    filler = [f"w{i}" for i in range(500)]
    texts = []
    for k in range(120):
        words = list(rng.choice(filler, rng.integers(0, 200)))
        if k % 3:
            template = list(L.TEMPLATES.values())[k % len(L.TEMPLATES)].split()
            if k % 2 and len(template) > 30:
                template[int(rng.integers(8, len(template) - 8))] = "changed"
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = template
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in L.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.containment, r.n_passages)
    want = {d: x for d, t in enumerate(texts) if (x := brute(t))}
    assert got == want and len(want) > 50


def test_neighbours_change_nothing():
    import pyarrow as pa

    found, rng = L.index(), np.random.Generator(np.random.PCG64(9))
    notice = L.TEMPLATES["mit-grant"].split()
    texts = [" ".join([*notice[:k], "inserted", *notice[k:]]) for k in range(4, 40, 3)] + list(L.TEMPLATES.values())
    alone = [[r[1:] for r in L.scan_texts(pa.array([t]), found)] for t in texts]
    assert all(alone)
    for _ in range(8):
        pads = [" ".join(f"w{i}" for i in rng.integers(0, 300, rng.integers(0, 90))) for _ in texts]
        order = rng.permutation(len(texts))
        got = L.scan_texts(pa.array([x for k in order for x in (pads[k], texts[k])]), found)
        for place, k in enumerate(order):
            assert [r[1:] for r in got if r[0] == 2 * place + 1] == alone[k]


def test_floor_of_the_bands():
    found = L.index()
    for c in found.classes:
        s = L.floor(c, found)
        assert s > 0.4 and 1 - (1 - s**L.ROWS) ** L.BANDS > 0.999, (c.templates, s)


def test_passages_and_odd_rows(spark, odd, nothing):
    notice = L.TEMPLATES["mit"]
    docs = spark.createDataFrame([(1, f"{notice} " + "x y z " * 40 + notice, "c"), (2, "Released under the", "c")], "doc_id bigint, text string, license string")
    got = L.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.start_word, r.n_passages) for r in got] == [(1, "mit", 0, 2)]
    assert L.scan_licenses(odd).count() == 0 and L.scan_licenses(nothing).count() == 0
    assert L.scan_licenses(docs, {"none": "!!"}).count() == 0


def test_near_copies_end_a_batch():
    import pyarrow as pa

    found = L.index()
    for name, at in (("mit-grant", 20), ("gpl-3.0", 0)):
        template = L.TEMPLATES[name].split()
        near = " ".join([*template[:at], "changed", *template[at + 1 :]])
        for k in range(0, 2 * max(c.step for c in found.classes), 3):
            for notice in (L.TEMPLATES[name], near):
                text = " ".join([*(f"w{i}" for i in range(k)), notice])
                got = {r[1]: r[2] for r in L.scan_texts(pa.array([text]), found)}
                assert got.get(name) == brute(text)[name][0], (name, k, got)
