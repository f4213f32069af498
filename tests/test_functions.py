import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions import text as T
from seamark.functions import vector as V
from seamark.operators import embed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column).first()[0]


def test_tokenize(spark):
    assert one(spark, T.tokenize(F.lit("fn parse_HF_Repo(x)!"))) == ["fn", "parse_hf_repo"]
    assert one(spark, T.tokenize(F.lit("привет мир"))) == []
    assert one(spark, T.query_terms(F.lit("b1 aa b1 AA"))) == ["aa", "b1"]


@pytest.mark.parametrize(("byte", "line"), [(0, 1), (2, 2), (5, 3), (9999, 4)])
def test_line_at(spark, byte, line):
    assert one(spark, T.line_at(F.lit("a\nbb\nccc\n"), F.lit(byte))) == line


def test_line_at_inside_a_character(spark):
    assert one(spark, T.line_at(F.lit("é\né"), F.lit(4))) == 2


def test_signature(spark):
    assert one(spark, T.signature(F.lit("\n  \u3000\n  def f(): \n x"))) == "def f():"
    assert one(spark, T.signature(F.lit("x" * 500))) == "x" * 160
    assert one(spark, T.signature(F.lit(" \n"))) == ""


@pytest.mark.parametrize(("scope", "clean"), [(" ./src/ ", "src"), ("././a\\b", "a/b"), ("/", ""), ("", "")])
def test_norm_scope(spark, scope, clean):
    assert one(spark, T.norm_scope(F.lit(scope))) == clean


@pytest.mark.parametrize(("path", "scope", "inside"), [("src/x", "src", True), ("src2/x", "src", False), ("src", "src", True), ("a", "", True)])
def test_in_scope(spark, path, scope, inside):
    assert one(spark, T.in_scope(F.lit(path), F.lit(scope))) is inside


@pytest.mark.parametrize(("path", "language"), [("a/B.RS", "rust"), ("x.hxx", "cpp"), ("x.unknown", "text"), (".rs", "text"), ("Makefile", "text"), ("a.b/c", "text")])
def test_language(spark, path, language):
    assert one(spark, T.language(F.lit(path))) == language


def test_is_text(spark):
    assert [one(spark, T.is_text(F.col("b")), b=bytearray(b)) for b in (b"abc", b"a\0b", b"\xff\xfe", "é".encode(), b"")] == [True, False, False, True, True]


@pytest.mark.parametrize("how", ["cls", "last", "mean"])
def test_pooling_agrees_with_numpy(spark, how):
    states, mask = [[1.0, 2.0], [3.0, -1.0], [9.0, 9.0]], [1, 1, 0]
    own = one(spark, V.pooled(F.col("s"), F.col("m"), how), s=states, m=mask)
    assert np.allclose(own, embed.pool(np.array([states]), np.array([mask]), how)[0])


def test_zero_vectors(spark):
    assert one(spark, V.l2_normalized(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.cosine(F.col("v"), F.col("v")), v=[0.0, 0.0]) == 0.0
    assert math.isclose(one(spark, V.cosine(F.col("v"), F.col("v")), v=[3.0, 4.0]), 1.0)


def test_due(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    ask = lambda last: one(spark, T.due(F.lit(last).cast("string"), now, F.lit(10)))
    assert [ask(x) for x in (None, "no time", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z")] == [True, True, True, False]
