import hashlib

import numpy as np

from seamark.llm import fingerprint as P


def slow(text):
    """The walk of one text, step by step."""
    walk, chars = P._Walk.get(), [max(1, ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF) >> 24) for c in text]
    nibble = lambda c: "0123456789abcdef"[((c * 0x85EBCA6B) & 0xFFFFFFFF) >> 28]
    at, out, k, j = 0, "", 0, 0
    while at < len(chars):
        sampled = set(walk.octave(k).tolist())
        for step in range(j, P.FIRST << k):
            if step in sampled:
                out += nibble(chars[at]) if at < len(chars) else "."
            if at < len(chars):
                at += int(walk.bits[step if step < P.PERIOD else (step * 0x9E3779B1 >> 7) % P.PERIOD][chars[at]])
        j, k = P.FIRST << k, k + 1
    return out


def test_against_a_step_by_step_walk():
    texts = ["", "a", "ab" * 10, "naïve 😀 text " * 7, "".join(chr(97 + i * i % 26) for i in range(3000)), "x\x00y" * 30]
    assert P.fingerprints(texts) == [slow(t) for t in texts]


def test_likeness():
    rng = np.random.Generator(np.random.PCG64(2))
    text = "".join(rng.choice(list("abcdefghij "), 2000))
    other = "".join(rng.choice(list("abcdefghij "), 2000))
    near = text[:1000] + "!" + text[1000:]
    a, b, c, d = P.fingerprints([text, near, other, text])
    assert P.likeness(a, d) == 1 and P.likeness(a, b) > 0.85 and P.likeness(a, c) < 0.35 and P.likeness("", "") == 1 and P.likeness(a, "") == 0


def check_edited(docs, got):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        f, e, x = P.fingerprints([t, edited, n])
        assert (r.fingerprint, r.edited_fingerprint) == (f, e) and (r.near_edited, r.near_next) == (P.likeness(f, e), P.likeness(f, x))
        k, ke, kx = (set(y.tolist()) for y in P.band_keys([f, e, x]))
        assert r.found_edited == (r.near_edited >= P.LEAST and (f == e or bool(k & ke))) and r.found_next == (r.near_next >= P.LEAST and (f == x or bool(k & kx)))


def test_every_document_meets_the_next(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = P.op10_fingerprint(spark, sf).collect()
    assert len(got) == len(docs)
    check_edited(docs, {r.doc_id: r for r in got})


def test_odd_rows(spark, odd, nothing):
    got = P.compare_with_edited(odd).collect()
    assert len(got) == 12 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert P.compare_with_edited(nothing).count() == 0
    for rows in ([(5, "abc def")], [(5, "abc"), (None, None), (2, "xyz")], [(1, "a"), (2, "")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        check_edited(rows, {r.doc_id: r for r in P.compare_with_edited(df).collect()})


def near_rows(chars):
    """Texts of many lengths, borders of octaves among them, each with an edited form and a copy."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows = []
    for i, n in enumerate(chars):
        text = "".join(rng.choice(list("abcdefghij "), n))
        at = int(rng.integers(0, n))
        rows += [(3 * i, text), (3 * i + 1, text[:at] + "??"[: 1 + i % 2] + text[at:]), (3 * i + 2, text)]
    return rows


def all_pairs(rows):
    p = dict(zip([r[0] for r in rows], P.fingerprints([r[1] for r in rows]), strict=True))
    return {(a, b) for a in p for b in p if a < b and a % 3 != 2 and b % 3 != 2 and p[a] != p[b] and P.likeness(p[a], p[b]) >= 0.8}


def test_near_pairs(spark, monkeypatch):
    rows = near_rows([*range(24, 72), *range(100, 148), *range(800, 1600, 16)])
    want = all_pairs(rows)
    octaves = {len(f) for f in P.fingerprints([r[1] for r in rows])}
    assert len(want) > 60 and len(octaves) > 4
    prints = spark.createDataFrame([(i, f) for (i, _), f in zip(rows, P.fingerprints([r[1] for r in rows]), strict=True)] + [(None, "ab"), (9999, "")], "doc_id bigint, fingerprint string")
    got = [(r.class_a, r.class_b) for r in P.near_pairs(prints).collect()]
    assert set(got) <= want and len(set(got)) == len(got) and len(got) >= 0.97 * len(want)
    monkeypatch.setattr(P, "BLOCK", 2)  # every band that three share is dealt out in blocks
    assert sorted(got) == sorted((r.class_a, r.class_b) for r in P.near_pairs(prints).collect())
    assert P.near_pairs(prints.where("false")).count() == 0


def test_bands_find_what_is_near():
    """Over lengths from one octave up: the share of near pairs that meet in a band, walks that end in different octaves included."""
    borders = [n + d for n in (64, 128, 256, 512) for d in range(-6, 4)]
    rows = near_rows([20 + 3 * (i % 400) for i in range(1200)] + borders * 100)
    prints = P.fingerprints([r[1] for r in rows])
    keys = [set(k.tolist()) for k in P.band_keys(prints)]
    near = [i for i in range(0, len(rows), 3) if P.LEAST <= P.likeness(prints[i], prints[i + 1]) < 1]
    split = [i for i in near if len(prints[i]) != len(prints[i + 1])]
    met = lambda some: sum(not keys[i].isdisjoint(keys[i + 1]) for i in some) / len(some)
    assert len(near) > 300 and len(split) > 30 and met(near) >= 0.98 and met(split) >= 0.9
    assert sum(not keys[i].isdisjoint(keys[i + 3]) for i in range(0, 3000, 3)) < 100  # unrelated texts
