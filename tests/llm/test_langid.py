from seamark.llm import langid as G


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in G.op8_language_id(spark, d).collect() if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97


def small_net(rng, kind="float64"):
    import numpy as np

    return G.Net(["a", "b", "c"], [(rng.standard_normal((w, 256, 2)) * 0.5).astype(kind) for w in G.WIDTHS], rng.standard_normal((2 * len(G.WIDTHS), 3)).astype(kind), rng.standard_normal(3).astype(kind))


def test_forward_pass_against_loops():
    import math

    import numpy as np
    import pyarrow as pa

    rng = np.random.Generator(np.random.PCG64(1))
    net = small_net(rng)
    windows, _, _ = G.windows_of(pa.array(["Some text é and more. " * 9, "x", "日本語"]))
    for got, row in zip(net.log_probabilities(windows), windows.tolist(), strict=True):
        features = []
        for f in net.filters:
            for k in range(f.shape[2]):
                features.append(max(0.0, max(sum(f[j, row[p + j], k] for j in range(len(f))) for p in range(G.WINDOW))))
        z = [sum(x * net.dense[i, c] for i, x in enumerate(features)) + net.bias[c] for c in range(3)]
        total = math.log(sum(math.exp(v) for v in z))
        assert np.allclose(got, [v - total for v in z])


def test_gradients_against_differences():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(2))
    net = small_net(rng)
    b, t = rng.integers(97, 101, (5, G.WINDOW + max(G.WIDTHS) - 1)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss, grads = G.loss_and_gradients(net, b, t)
    assert abs(loss + net.log_probabilities(b)[np.arange(5), t].mean()) < 1e-9
    for x, g in zip([*net.filters, net.dense, net.bias], grads, strict=True):
        for at in zip(*(a[:6] for a in np.nonzero(g)), strict=True):
            old, sides = x[at], []
            for e in (1e-6, -1e-6):
                x[at] = old + e
                sides.append(G.loss_and_gradients(net, b, t)[0])
            x[at] = old
            assert abs((sides[0] - sides[1]) / 2e-6 - g[at]) < 1e-4


def test_odd_rows(spark, odd, nothing):
    net = G.fit(odd)
    got = G.predict(odd, net).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and sum(r.lang_pred == "und" for r in got) == 4
    assert G.fit(nothing) is None and G.predict(nothing, net).count() == 0
    assert {(r.lang_pred, r.score) for r in G.predict(odd, None).collect()} == {("und", 0.0)}


def test_whole_text_counts(spark):
    from seamark.llm.langid import WINDOW, windows_of
    import pyarrow as pa

    windows, text, length = windows_of(pa.array(["a" * (WINDOW * 3 + 5), None, "b"]))
    assert text.tolist() == [0, 0, 0, 0, 2] and length.tolist() == [WINDOW, WINDOW, WINDOW, 5, 1] and windows[3, 5] == 0


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)} " * 30, f"l{k:02}") for k in range(70) for i in range(6 if k else 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = G.fit(docs)
    assert net.langs == sorted({r[2] for r in rows})
    got = {r.doc_id: r.lang_pred for r in G.predict(docs, net).collect()}
    assert {got[i] for i in range(3)} == {"l00"}
