"""Vector functions on arrays of floats, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def l2_normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def pooled(states: Column, mask: Column, how: str) -> Column:
    """Pool token states (array of vectors) under a mask (array of 0 and 1), then normalise.

    ``cls``: the first token; ``last``: the last unmasked one, else the first; ``mean``: of the
    unmasked ones, zero without any.
    """
    first = F.get(states, F.lit(0))
    if how == "cls":
        picked = first
    elif how == "last":
        picked = F.coalesce(F.get(F.reverse(F.filter(states, lambda _, i: F.get(mask, i) != 0)), F.lit(0)), first)
    elif how == "mean":
        kept = F.filter(states, lambda _, i: F.get(mask, i) != 0)
        count = F.greatest(F.size(kept), F.lit(1))
        zero = F.transform(first, lambda x: x.cast("double") * 0)
        picked = F.transform(F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double"))), lambda x: x / count)
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return l2_normalized(picked)


def stub_vector(text: Column, dims: int) -> Column:
    """A deterministic vector of a text's SHA-256 digest, for tests: not normalised, no meaning."""
    value = lambda h, i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR((i * 31) % 256) / 127.5 - 1
    # the digest is bound to a variable, so it is made once
    return F.transform(F.array(F.sha2(F.encode(text, "utf-8"), 256)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: value(h, i)))[0]
