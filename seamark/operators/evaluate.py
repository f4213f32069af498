"""Retrieval evaluation: ranks of gold answers, and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from .search import MAX_QUERIES, TILE, knn_batch


def gold_ranks(vectors: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """qid and the 1-based rank of its gold vector among all, ties by id; rows + 1 if it has none.

    A rank is one more than the vectors that come before the gold one: tiles of vectors meet tiles of queries in matrix
    products, and a task hands on a count for each query. Queries are a request's own, MAX_QUERIES at most.
    """
    total = vectors.agg((F.count("*") + 1).alias("absent"))
    asked = queries.select("qid", "vector").join(gold.select("qid", F.col("vector_id").alias("gold_id")), "qid")
    own = asked.join(vectors.select(F.col("vector_id").alias("gold_id"), F.col("embedding").alias("_g")), "gold_id", "left").select("qid", "vector", "gold_id", "_g")
    rows = own.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one call")
    known = [r for r in rows if r["_g"] is not None]
    ids, golds = np.array([r.qid for r in known], np.int64), np.array([r.gold_id for r in known], np.int64)
    matrix, answers = np.array([r.vector for r in known], np.float64), np.array([r["_g"] for r in known], np.float64)
    norms = np.linalg.norm(matrix, axis=-1) if known else np.zeros(0)
    edge = np.round((matrix * answers).sum(axis=1) / np.maximum(norms * np.linalg.norm(answers, axis=1), 1e-12), 9) if known else norms
    shared = vectors.sparkSession.sparkContext.broadcast((ids, golds, matrix, norms, edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, golds, matrix, norms, edge = shared.value
        before = np.zeros(len(ids), np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                own = np.asarray(part.column(0))
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                length = np.linalg.norm(x, axis=1)
                for q in range(0, len(ids), TILE):
                    cos = np.round(matrix[q : q + TILE] @ x.T / np.maximum(norms[q : q + TILE, None] * length[None], 1e-12), 9)
                    least = edge[q : q + TILE, None]
                    before[q : q + TILE] += ((cos > least) | ((cos == least) & (own[None] < golds[q : q + TILE, None]))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(before)], names=["qid", "n"])

    found = vectors.select(F.col("vector_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, "qid bigint, n bigint").groupBy("qid").agg((F.sum("n") + 1).alias("rank"))
    return own.select("qid").join(found, "qid", "left").crossJoin(total).select("qid", F.coalesce("rank", "absent").alias("rank"))  # total is one row


def golden_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """qid and rank of the first hit (ord from 0, file_path) in the expected file; null if none."""
    right = hits.join(expected.select("qid", "expected"), "qid").where("file_path = expected").groupBy("qid").agg((F.min("ord") + 1).cast("bigint").alias("rank"))
    return expected.select("qid").join(right, "qid", "left")


def metrics(ranks: DataFrame, rank: Column | None = None) -> DataFrame:
    """One row: n, mrr_10, recall_1, recall_5, ndcg_10, rounded to 4 places; a null rank is a miss."""
    rank = F.col("rank") if rank is None else rank
    n = F.greatest(F.count("*"), F.lit(1))
    mean = lambda x, most: F.round(F.coalesce(F.sum(F.when(rank <= most, x)), F.lit(0.0)) / n, 4)
    return ranks.agg(F.count("*").alias("n"), mean(1.0 / rank, 10).alias("mrr_10"), mean(F.lit(1.0), 1).alias("recall_1"), mean(F.lit(1.0), 5).alias("recall_5"), mean(1.0 / F.log2(rank + 1.0), 10).alias("ndcg_10"))


def precision_equivalence(a: DataFrame, b: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: mean and least cosine of two embeddings of the same ids, and the share of queries with the same best."""
    both = a.select("vector_id", F.col("embedding").alias("x")).join(b.select("vector_id", F.col("embedding").alias("y")), "vector_id").withColumn("cos", cosine(F.col("x"), F.col("y")))
    tops = knn_batch(a, queries, 1).select("qid", F.col("vector_id").alias("a")).join(knn_batch(b, queries, 1).select("qid", F.col("vector_id").alias("b")), "qid")
    same = tops.agg(F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("top1_agreement"))
    return both.agg(F.round(F.avg("cos"), 6).alias("mean_cosine"), F.round(F.min("cos"), 6).alias("min_cosine")).crossJoin(same)  # one row each


def rerank_ranks(ranks: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """Ranks after the first ``top`` candidates of each query were scored anew.

    ``scores`` has qid, ord (from 0, before), gold (boolean) and score. A gold answer outside keeps its rank.
    """
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord"))
    inside = scores.where(F.col("ord") < top).withColumn("new", order).where("gold").groupBy("qid").agg(F.min("new").alias("new"))
    return ranks.join(inside, "qid", "left").select("qid", F.coalesce("new", "rank").alias("rank"))
