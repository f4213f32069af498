"""Hybrid search: exact vector neighbours, BM25 over them, Reciprocal Rank Fusion, optional re-ranking.

Everything works on a table of queries at once and every window is partitioned by query. A
``queries`` table has qid, text and vector, and is a request's own: it is checked against MAX_QUERIES before it is
broadcast; more queries go in several calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_scope, line_at, query_terms, signature, tokenize
from ..functions.vector import cosine
from ..tables import durable

K1, B, RRF_K = 1.2, 0.75, 60
OVERFETCH, LEAST_FETCH = 40, 400
RERANK_TOP = 50
MAX_QUERIES = 20_000
#: Vectors and queries in one matrix product.
TILE = 1024
SERVER_LIMITS = (1, 10, 50)


def budget(limit: int, hybrid: bool, scoped: bool) -> int:
    """How many neighbours to fetch for ``limit`` results."""
    return max(OVERFETCH * limit, LEAST_FETCH) if hybrid or scoped else limit


def server_limit(limit: int | None) -> int:
    low, usual, high = SERVER_LIMITS
    return usual if limit is None else max(low, min(high, limit))


def _rank(partition: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vector_id, embedding) nearest to one query: adds cos; ties by id.

    The plan is a scan with a top-k: no sort of the whole table.
    """
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("cos", F.round(cosine(F.col("embedding"), wanted), 9)).orderBy(F.desc("cos"), "vector_id").limit(k)


def _best(ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row by cosine, ties by id; only rows at or above the k-th cosine are sorted."""
    if cos.shape[1] > k:
        edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        most = int((cos >= edge).sum(axis=1).max())  # more than k where some tie with the k-th
        keep = np.argpartition(-cos, most - 1, axis=1)[:, :most] if most < cos.shape[1] else np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
        ids, cos = np.take_along_axis(ids, keep, 1), np.take_along_axis(cos, keep, 1)
    order = np.lexsort((ids, -cos), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for every row of ``queries`` (qid, vector): qid, vector_id, cos.

    TILE vectors meet TILE queries in one matrix product, and a task keeps the ``k`` best of each query as it goes: what it
    holds is k rows a query, and that is all it hands on, whatever the vectors' number and width.
    """
    rows = queries.select("qid", "vector").where("vector is not null").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one call")
    if not rows:
        return vectors.sparkSession.createDataFrame([], "qid bigint, vector_id bigint, cos double")
    ids = np.array([r.qid for r in rows], np.int64)
    matrix = np.array([r.vector for r in rows], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, np.linalg.norm(matrix, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, norms = shared.value
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by the first query of a tile: ids and cosines, k a query
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                own = np.asarray(part.column(0))
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                length = np.linalg.norm(x, axis=1)
                for q in range(0, len(ids), TILE):
                    cos = np.round(matrix[q : q + TILE] @ x.T / np.maximum(norms[q : q + TILE, None] * length[None], 1e-12), 9)
                    mine = np.broadcast_to(own, cos.shape)
                    if q in top:
                        mine, cos = np.concatenate([top[q][0], mine], 1), np.concatenate([top[q][1], cos], 1)
                    top[q] = _best(mine, cos, k)
        for q, (mine, cos) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q : q + TILE], mine.shape[1])), pa.array(mine.ravel()), pa.array(cos.ravel())], names=["qid", "vector_id", "cos"])

    found = vectors.select(F.col("vector_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, "qid bigint, vector_id bigint, cos double")
    return found.withColumn("sem", _rank("qid", F.desc("cos"), F.col("vector_id"))).where(F.col("sem") < k).drop("sem")


def materialized(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join hits with their chunks; ids without a chunk are dropped."""
    return hits.join(chunks, "vector_id")


def prepared(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds dl (tokens of the content) and counts (term and tf of the query's terms that it has), without the content.

    A content that many queries have found is tokenised once, and only what some query asks for is counted.
    """
    terms = queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term"))  # MAX_QUERIES bounds it
    texts = candidates.select("vector_id", "content").dropDuplicates(["vector_id"]).select("vector_id", tokenize(F.col("content")).alias("tokens"))
    texts = durable(texts)
    tf = texts.select("vector_id", F.explode("tokens").alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("vector_id", "term").agg(F.count("*").cast("int").alias("tf"))
    pairs = candidates.select("qid", "vector_id")
    counts = pairs.join(tf, "vector_id").join(F.broadcast(terms), ["qid", "term"]).groupBy("qid", "vector_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("counts"))  # as many as the query has terms
    slim = candidates.drop("content").join(texts.select("vector_id", F.size("tokens").alias("dl")), "vector_id").join(counts, ["qid", "vector_id"], "left")
    return slim.withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<term:string,tf:int>>")))


def bm25(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 of each candidate (qid, vector_id, content, or already prepared) against its query's distinct terms.

    The corpus is the query's candidate set. Adds bm25, 0 without a term in common. Scores have 9 places,
    so ties don't hang on the order of summation.
    """
    if "counts" not in candidates.columns:
        return candidates.join(bm25(prepared(candidates.select("qid", "vector_id", "content"), queries), queries), ["qid", "vector_id"])
    rows = candidates
    df = rows.select("qid", F.inline("counts")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    stats = rows.groupBy("qid").agg(F.count("*").alias("_n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("_avgdl"))
    stats = stats.join(df.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("_df")), "qid", "left")  # a row a query
    idf = lambda term: F.log(1 + (F.col("_n") - F.element_at("_df", term) + 0.5) / (F.element_at("_df", term) + 0.5))
    part = lambda c: idf(c["term"]) * c["tf"] * (K1 + 1) / (c["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("_avgdl")))
    score = F.round(F.aggregate("counts", F.lit(0.0), lambda s, c: s + part(c)), 9)
    return rows.join(F.broadcast(stats), "qid").withColumn("bm25", score).drop("_n", "_avgdl", "_df", "dl", "counts")


def fused(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Reciprocal Rank Fusion of cosine and BM25 ranks: adds bm25, sem, lex, score and ord.

    ``candidates`` has qid, vector_id, cos and content. A query without terms keeps its cosine order and score.
    """
    ranked = bm25(candidates, queries).withColumn("sem", _rank("qid", F.desc("cos"), F.col("vector_id")))
    ranked = ranked.withColumn("lex", _rank("qid", F.desc("bm25"), F.col("sem")))
    lexical = queries.select("qid", (F.size(query_terms(F.col("text"))) > 0).alias("hybrid"))
    rrf = 1 / (F.lit(RRF_K) + F.col("sem")) + 1 / (F.lit(RRF_K) + F.col("lex"))
    scored = ranked.join(F.broadcast(lexical), "qid").withColumn("score", F.when(F.col("hybrid"), F.round(rrf, 12)).otherwise(F.col("cos"))).drop("hybrid")
    return scored.withColumn("ord", _rank("qid", F.desc("score"), F.col("sem")))


def reranked(ordered: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column], top: int = RERANK_TOP) -> DataFrame:
    """Re-score the first ``top`` of each query by ``scorer`` of query text and content; the rest stays as it is."""
    scored = ordered.join(F.broadcast(queries.select("qid", F.col("text").alias("_q"))), "qid")
    first = F.col("ord") < top
    scored = scored.withColumn("score", F.when(first, scorer(F.col("_q"), F.col("content"))).otherwise(F.col("score"))).drop("_q")
    return scored.withColumn("ord", _rank("qid", F.when(first, 0).otherwise(1), F.when(first, -F.col("score")).otherwise(F.col("ord")), F.col("ord")))


def term_overlap(query: Column, content: Column) -> Column:
    """A stand-in re-ranker: the share of the query's terms that the content has."""
    terms = query_terms(query)
    return F.round(F.size(F.array_intersect(terms, tokenize(content))) / F.greatest(F.size(terms), F.lit(1)), 9)


def neighbours(chunks: DataFrame) -> DataFrame:
    """Adds prev_id and next_id: the chunks before and after in the same file."""
    order = Window.partitionBy("file_path").orderBy("chunk_index")
    return chunks.withColumns({"prev_id": F.lag("vector_id").over(order), "next_id": F.lead("vector_id").over(order)})


def parents(chunks: DataFrame) -> DataFrame:
    """vector_id and parent_id: the smallest other chunk of the file that spans it, of equal ones the first.

    A file's chunks come in order of their start, the longer first, and only those that still reach further are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # end, start, chunk_index, vector_id
        for batch in batches:
            own, found = [], []
            for path, vector, start, end, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    now, held = path, []
                held = [h for h in held if h[0] >= start]
                around = [(h[0] - h[1], h[2], h[3]) for h in held if h[0] >= end and h[3] != vector]
                if around:
                    own.append(vector)
                    found.append(min(around)[2])
                held.append((end, start, index, vector))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.int64())], names=["vector_id", "parent_id"])

    span = chunks.select("file_path", "vector_id", "start_byte", "end_byte", F.col("chunk_index").cast("bigint").alias("chunk_index"))
    # of equal spans the first is the parent of all others, and has the second
    same = Window.partitionBy("file_path", "start_byte", "end_byte").orderBy("chunk_index", "vector_id")
    twins = span.withColumns({"_first": F.first("vector_id").over(same), "_next": F.lead("vector_id").over(same)})
    twins = twins.select("vector_id", F.when(F.col("vector_id") == F.col("_first"), F.col("_next")).otherwise(F.col("_first")).alias("twin"))
    above = span.repartition("file_path").sortWithinPartitions("file_path", "start_byte", F.desc("end_byte"), "chunk_index", "vector_id").mapInArrow(run, "vector_id bigint, parent_id bigint")
    both = twins.join(above, "vector_id", "left")
    return both.select("vector_id", F.coalesce("twin", "parent_id").alias("parent_id")).where("parent_id is not null")


def results(ordered: DataFrame, chunks: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each query as result rows, with lines, parent, prev and next.

    ``ordered`` has qid, vector_id, score and ord; ``chunks`` has vector_id, file_path, language,
    node_type, chunk_index, start_byte, end_byte and content; ``files`` has path and text. Only the files of
    the results are looked at. Lines are 0 where a file's text is gone.
    """
    top = ordered.where(F.col("ord") < limit).select("qid", "vector_id", "score", "ord")
    wanted = top.join(chunks.select("vector_id", "file_path"), "vector_id").select("file_path").distinct()
    near = chunks.join(wanted, "file_path", "left_semi").join(files.select(F.col("path").alias("file_path"), "text"), "file_path", "left")
    line = lambda c: F.coalesce(line_at(F.col("text"), F.col(c)), F.lit(0).cast("bigint"))
    near = near.withColumns({"signature": signature(F.col("content")), "start_line": line("start_byte"), "end_line": line("end_byte")}).drop("text")
    ref = near.select(F.col("vector_id").alias("ref_id"), F.struct("node_type", "signature", "start_line", "end_line").alias("ref"))
    rows = top.join(neighbours(near), "vector_id").join(parents(near), "vector_id", "left")
    for name in ("parent", "prev", "next"):
        rows = rows.join(ref.select(F.col("ref_id").alias(f"{name}_id"), F.col("ref").alias(name)), f"{name}_id", "left")
    return rows.select("qid", "ord", "vector_id", "file_path", "language", "node_type", "signature", "parent", "start_line", "end_line", "content", "prev", "next", "score")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, scope: str | None = None, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Ordered candidates of all queries: qid, vector_id, file_path, content, cos, bm25, sem, lex, score, ord.

    Scope is applied to the fetched neighbours, so fewer than ``limit`` may be left. Candidates are
    ranked without their content, which is joined again to those that are returned or re-ranked.
    """
    found = materialized(knn_batch(vectors, queries, budget(limit, True, bool(scope))), chunks)
    if scope:
        found = found.where(in_scope(F.col("file_path"), F.lit(scope)))
    ids = durable(found.select("qid", "vector_id", "cos"))  # MAX_QUERIES times the budget at most
    slim = durable(prepared(materialized(ids, chunks.select("vector_id", "content")), queries))
    ordered = fused(slim, queries)
    kept = ordered.where(F.col("ord") < (max(limit, RERANK_TOP) if rerank else limit))
    full = kept.join(chunks, "vector_id")
    if rerank is None:
        return full
    return reranked(full, queries, rerank).where(F.col("ord") < limit)
