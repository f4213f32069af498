"""Approximate neighbours by inverted lists: vectors are filed under their nearest of a few centres.

Centres are fitted on a bounded sample; every vector is indexed; a query probes the cells nearest
to it and its candidates are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine

SAMPLE, ITERATIONS, SEED = 20_000, 12, 7
EXACT_BELOW = 50_000
#: Cells: about the root of the vectors' number, so many at most; which share of the exact neighbours the probes have to find.
LEAST_CELLS, MOST_CELLS, RECALL = 16, 1024, 0.95


def backend(vectors: int, exact_below: int = EXACT_BELOW) -> str:
    return "exact" if vectors < exact_below else "cells"


def cells_for(vectors: int) -> int:
    return max(LEAST_CELLS, min(MOST_CELLS, math.isqrt(vectors)))


def probed(queries: DataFrame, centres: np.ndarray, probes: int) -> list[int]:
    """Cells that one of ``queries`` (a request's own) probes."""
    q = np.array([r.vector for r in queries.where("vector is not null").select("vector").collect()], np.float64)
    return np.unique(np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]).tolist() if len(q) else []


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` unit vectors: those with the smallest hashes of their ids."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("vector_id"), "vector_id").limit(sample).select("embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def probes_for(x: np.ndarray, centres: np.ndarray, target: float, k: int = 10, queries: int = 200) -> int:
    """The fewest cells to probe for a mean recall of ``target`` at ``k``, as measured within a sample of unit vectors."""
    own, asked = (x @ centres.T).argmax(axis=1), x[:queries]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
    need = np.take_along_axis(place, own[best], 1)
    return next((p for p in range(1, len(centres)) if (need < p).mean() >= target), len(centres))


def fit_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means centres of a sample of unit vectors."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` (vector_id, embedding) with the cell of each."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x @ shared.value.T).argmax(axis=1).astype(np.int32))], names=["vector_id", "embedding", "cell"])

    return vectors.where("embedding is not null").select(F.col("vector_id").cast("bigint"), F.col("embedding").cast("array<float>")).mapInArrow(run, "vector_id bigint, embedding array<float>, cell int")


def ann_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """qid, vector_id, cos of the ``k`` best of each query within its ``probes`` nearest cells."""
    rows = queries.select("qid", "vector").collect()
    q = np.array([r.vector for r in rows], np.float64)
    near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
    probed = sorted({int(c) for row in near for c in row})
    pairs = index.sparkSession.createDataFrame([(int(r.qid), int(c)) for r, row in zip(rows, near, strict=True) for c in row], "qid bigint, cell int")
    candidates = index.where(F.col("cell").isin(probed))
    return _within(candidates, pairs, queries, k)


def _within(candidates: DataFrame, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = pairs.join(queries.select("qid", "vector"), "qid")
    scored = candidates.join(F.broadcast(asked), "cell").select("qid", "vector_id", F.round(cosine(F.col("embedding"), F.col("vector")), 9).alias("cos"))  # a request's own queries and probes
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "vector_id"))
    return scored.withColumn("k", rank).where(F.col("k") <= k).drop("k")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid and the share of the exact neighbours that were found."""
    hit = exact.select("qid", "vector_id").join(found.select("qid", "vector_id").withColumn("hit", F.lit(1)), ["qid", "vector_id"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
