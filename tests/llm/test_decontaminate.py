import math

from seamark.llm import decontaminate as D

ITEM = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while in the warm sun of the garden near the old stone wall"


def run(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string, a int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}


def test_finds_copies_and_leaves_others(spark):
    pad = " ".join(f"p{i}" for i in range(300))
    words = ITEM.split()
    near = " ".join([*words[:-1], "fence"])
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    got = run(spark, [f"{pad} {ITEM.upper()}! {pad}", ITEM, f"{pad} {near}", f"{pad} {far} {pad}", pad, None, "", "short one", " ".join(words[:12])])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}
    assert got[0, 0].similarity == 1 and got[0, 0].start_word == 300 and got[0, 0].n_words == len(words) and 0.8 <= got[2, 0].similarity < 1


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(0, "one two three four five six seven"), (1, "ONE two, three four five six seven"), (2, None), (3, "a b"), (None, ITEM), (4, "one two three four five six seven")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(odd, bench).collect()}
    assert got == {(d, i) for d in (1, 5) for i in (0, 1, 4)}
    assert D.contaminated(nothing, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0


def test_the_index_finds_all_within_the_radius(spark):
    import random

    from pyspark.sql import functions as F

    assert sum(D.REACH) == D.RADIUS - D.BLOCKS + 1
    r = random.Random(3)
    rows = []
    for _ in range(60):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), D.RADIUS):
            b ^= 1 << k
        rows.append((a - (1 << 63), b - (1 << 63), r.getrandbits(64) - (1 << 63)))
    meet = lambda x: F.size(F.array_intersect(D.listed(F.col("a")), D.looked_up(F.col(x))))
    got = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").select(meet("b").alias("near"), meet("c").alias("far")).collect()
    assert all(x.near >= 1 for x in got) and sum(x.far > 0 for x in got) < 30  # and most others not


def shingles(text):
    words = text.split()
    return [tuple(words[i : i + D.SHINGLE]) for i in range(len(words) - D.SHINGLE + 1)]


def all_windows(text, item, items):
    """Similarity, start and words of the best of all item-sized windows, those that hang over either end included."""
    sets = [set(shingles(t)) for t in dict.fromkeys(items)]
    weigh = lambda own: sum(math.log(1 + len(sets) / max(1, sum(x in o for o in sets))) for x in own)
    s, want = shingles(text), shingles(item)
    found = []
    for a in range(1 - len(want), len(s)):
        lo, hi = max(a, 0), min(a + len(want), len(s))
        own = set(s[lo:hi])
        both = weigh(own & set(want))
        found.append((-round(both / (weigh(own) + weigh(set(want)) - both), 6), lo, hi - lo + D.SHINGLE - 1))
    return min(found)


def against_all_windows(spark, texts, items):
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            best = all_windows(t, x, items)
            if -best[0] >= D.THRESHOLD:
                want[d, i] = best
    got = {k: (-r.similarity, r.start_word, r.n_words) for k, r in run(spark, texts, items).items()}
    assert got == want
    return set(want)


def test_reordered_passages(spark):
    pad = " ".join(f"p{i}" for i in range(60))
    texts, items = [], []
    for n in (40, 50, 59):
        words = [f"w{n}x{i}" for i in range(n)]
        h, third = n // 2, n // 3
        swapped = " ".join(words[h:] + words[:h])
        items.append(" ".join(words))
        texts += [f"{pad} {swapped} {pad}", swapped, f"{pad} {swapped}", f"{swapped} {pad}", f"{pad} {' '.join(words[2 * third :] + words[third : 2 * third] + words[:third])} {pad}", f"{pad} {' '.join([*words[:h], 'x', *words[h:]])} {pad}", f"{pad} {items[-1]}"]
    assert {(d, d // 7) for d in range(21) if d % 7 in (0, 1, 2, 3, 6)} <= against_all_windows(spark, texts, items)


def test_words_inserted_in_the_middle(spark):
    """Passages whose best window begins where no shared shingle puts it, of items that share their ends."""
    pad = " ".join(f"p{i}" for i in range(120))
    texts, items = [], []
    for n in (60, 90, 120):
        words = [f"w{n}x{i}" for i in range(n)]
        items += [" ".join(words), *(" ".join([*words[: n // 3], *(f"o{n}x{k}x{i}" for i in range(n // 3)), *words[-(n // 3) :]]) for k in range(2))]
        for more in (1, 3, 6):
            texts.append(f"{pad} {' '.join([*words[: n // 2], *(f'in{i}' for i in range(more)), *words[n // 2 :]])} {pad}")
    found = against_all_windows(spark, texts, items)
    assert found


def test_ends_of_texts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 16)
    words = ITEM.split()
    pad = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(words[3:]) + " " + pad, f"{pad} {' '.join(words[:-3])}", " ".join(words[2:-2]), f"{pad} {ITEM} {pad} {ITEM}", f"{ITEM} {ITEM}"]
    assert {d for d, _ in against_all_windows(spark, texts, [ITEM])} == {0, 1, 2, 3, 4}


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (1, "other words that match nothing at all"), (2, ITEM), (None, ITEM)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in D.contaminated(docs, bench).collect()) == [(1, 7, 1.0), (2, 7, 1.0)]
