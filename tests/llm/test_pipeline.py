import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as C
from seamark.llm import decontaminate, langid, mixing, toxicity
from seamark.llm.common import table

from .test_jaccard_join import brute


def recomputed(spark, name, docs, path, sf):
    """The ids that a stage should keep, by a plain computation over all that the one before it kept."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW kept AS SELECT * FROM '{path}'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    if name == "toxicity":
        model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf, "labels")))
        import pyarrow as pa

        found = toxicity.scan(pa.array(list(texts.values())), model.words, model.weights, model.drift)
        return {i for i, (n, spans) in zip(texts, found, strict=True) if model.probability(model.p_value(max((s for *_, s in spans), default=0.0), n)) < 0.5}
    if name == "language_id":
        net, out = langid.fit(docs), set()
        import numpy as np
        import pyarrow as pa

        for i, t in texts.items():
            windows, _, length = langid.windows_of(pa.array([t]))
            if len(windows) and any(c.isalpha() for c in t):
                p = np.exp((net.log_probabilities(windows) * length[:, None]).sum(axis=0) / length.sum())
                if (p / p.sum()).max() >= C.LEAST_LANG:
                    out.add(i)
        return out
    if name == "near_copies":
        return {g for _, g in brute(list(texts.items())).values()}
    if name == "decontamination":
        return set(texts) - {r[0] for r in con.sql(decontaminate.oracle("kept")).fetchall()}
    return {r[0] for r in con.sql(mixing.oracle("kept")).project("doc_id").fetchall()}


def test_stages(spark, sf, tmp_path):
    docs, path = table(spark, sf, "documents"), f"{sf}/documents.parquet"
    sizes = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert tuple(out.columns) == C.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/{name}").select("doc_id").collect()]
        assert sorted(ids) == sorted(recomputed(spark, name, docs, path, sf)), name
        docs, path = spark.read.parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{name}/*.parquet"
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert sorted(r.doc_id for r in C.run(spark, sf).collect()) == sorted(ids)  # run() is the stages


def test_rows_are_judged_by_themselves(spark, sf):
    item = table(spark, sf, "benchmark").where(F.length("text") > 100).orderBy("item_id").first().text
    own = "words that stand for themselves and are like nothing else in this small table of texts " + " ".join(f"own{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(5, own), (5, other), (3, other), (None, other), (None, item), (7, item), (7, own + " and more"), (8, None), (9, own + " and more"), (9, own + " and more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = sorted(((r.doc_id, r.text) for r in C.drop_near_copies(spark, docs, sf).collect()), key=repr)
    assert left == sorted([(3, other), (5, own), (7, item), (8, None)], key=repr)
    left = sorted(((r.doc_id, r.text) for r in C.drop_contaminated(spark, docs, sf).collect()), key=repr)
    assert left == sorted([r for r in rows if r[1] != item], key=repr)


def test_odd_rows(spark, odd, nothing, sf):
    for rows in (odd, nothing):
        docs = rows
        for _, stage in C.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() <= rows.count()


def test_unknown_languages_go(spark, odd, sf):
    out = C.drop_unknown_language(spark, odd, sf)
    assert not {2, 3, 4} & {r.doc_id for r in out.collect()} and langid.UNKNOWN == "und"
