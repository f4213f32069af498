import pytest
from pyspark.sql import functions as F

from seamark.llm import mixing as M


def cells_of(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), M.topic_of(F.col("text")).alias("topic"), M.tokens_of(F.col("text")).alias("tokens"))
    return docs.groupBy(*M.AXES).agg(F.sum("tokens").alias("tokens"))


@pytest.mark.parametrize("large", [False, True])
def test_marginals_meet_given_targets(spark, monkeypatch, large):
    """Also where cells are too many for one task."""
    if large:
        monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    cells = cells_of(spark)
    seen = cells.toPandas()
    given = {axis: {v: 1.0 + k % 3 for k, v in enumerate(sorted(seen[axis].unique()))} for axis in ("lang", "topic")}
    targets = spark.createDataFrame([(a, v, s) for a, x in given.items() for v, s in x.items()] + [("lang", "never seen", 5.0)], "axis string, value string, share double")
    raked = M.rake(cells, M.checked(targets), tolerance=1e-7 if large else M.TOLERANCE).toPandas()
    for axis in M.AXES:
        want = given.get(axis) or seen.groupby(axis).tokens.sum().to_dict()  # an axis without targets stays as it is
        got = (raked.groupby(axis).weight.sum() / raked.weight.sum()).to_dict()
        assert got == pytest.approx({v: s / sum(want.values()) for v, s in want.items()}, abs=1e-6)
    assert raked.weight.sum() == pytest.approx(seen.tokens.sum(), rel=1e-6)


def test_tempered_targets(spark):
    cells = cells_of(spark)
    raked, seen = M.rake(cells, M.tempered(cells)).toPandas(), cells.toPandas()
    for axis in M.AXES:
        t = seen.groupby(axis).tokens.sum() ** M.TEMPER[axis]
        assert (abs(raked.groupby(axis).weight.sum() / raked.weight.sum() - t / t.sum()) < 1e-6).all(), axis


def test_targets_out_of_reach(spark):
    rows = [(1, "a", "en", "x"), (2, "b", "de", "x")]  # a source has one language each
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = lambda *rows: spark.createDataFrame(rows, "axis string, value string, share double")
    for bad in (targets(("source", "a", 0.9), ("source", "b", 0.1), ("lang", "en", 0.1), ("lang", "de", 0.9)), targets(("lang", "xx", 1.0)), targets(("lang", "en", -1.0)), targets(("lang", "en", 1.0), ("lang", "en", 2.0)), targets(("color", "en", 1.0))):
        with pytest.raises(ValueError):
            M.mix(docs, bad)


def test_given_topics_and_tokens(spark):
    rows = [(k, f"t{k % 2}", 10 + k, "x") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, kind string, n int, text string").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en")})
    targets = spark.createDataFrame([("topic", "t0", 3.0), ("topic", "t1", 1.0)], "axis string, value string, share double")
    got = M.mix(docs, targets, F.col("kind"), F.col("n")).toPandas()
    assert (got.tokens == got.doc_id + 10).all() and (got[got.topic == "t0"].probability == 1).all() and 0.3 < got[got.topic == "t1"].probability.iloc[0] < 0.4
    assert (got.topic == "t0").sum() == 200 and 40 < (got.topic == "t1").sum() < 95  # about a third of 200


def test_odd_rows(spark, odd, nothing):
    got = M.mix(odd).collect()
    assert 0 < len(got) <= 12 and all(0 < r.probability <= 1 and r.tokens >= 1 for r in got)
    assert {r.lang for r in got} <= {"en", "de", "fr", "unknown"}
    assert M.mix(nothing).count() == 0
    assert sorted(map(str, M.mix(odd).collect())) == sorted(map(str, got))
