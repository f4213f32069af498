"""Inspection of an index: counts, listings, status and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import due
from .sync import merkle_root, short_root

LARGE_FILES, LARGE_SECONDS = 1500, 15


def list_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """path and chunks (0 for none), by path."""
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))
    return files.join(counts, "file_id", "left").select("path", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks")).orderBy("path")


def chunks_for_file(files: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    return chunks.join(files.where(F.col("path") == path).select("file_id"), "file_id", "left_semi").orderBy("chunk_index")


def chunk_by_vector_id(chunks: DataFrame, vector_id: int) -> DataFrame:
    return chunks.where(F.col("vector_id") == vector_id)


def vector_ids_for_file(chunks: DataFrame, file_id: int) -> DataFrame:
    return chunks.where(F.col("file_id") == file_id).select("vector_id")


def counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, meta: DataFrame, now, minutes: int = 10, backend: str = "exact") -> DataFrame:
    """One row about the index; reads no model. ``now`` is a timestamp column. A root that meta holds is not computed again."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    said = meta.agg(value("model_name"), value("last_sync_at"), value("merkle_root"))
    row = counts(files, chunks).crossJoin(vectors.agg(F.count("*").alias("vector_count"))).crossJoin(said)  # one row each
    if meta.where("key = 'merkle_root'").isEmpty():
        row = row.drop("merkle_root").crossJoin(merkle_root(files).withColumnRenamed("root", "merkle_root"))
    return row.select(
        "files", "chunks", "vector_count", F.col("model_name").alias("model"), "last_sync_at", F.try_to_timestamp("last_sync_at").isNull().alias("is_stale"),
        due(F.col("last_sync_at"), now, F.lit(minutes)).alias("resync_due"), F.lit(backend).alias("search_backend"), short_root(F.col("merkle_root")).alias("merkle_root"),
    )


def violations(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """rule and rows: how often the keys and references of the index don't hold."""
    twice = lambda t, c: t.groupBy(c).count().where("count > 1").agg(F.count("*").alias("rows"))
    rules = {
        "file path repeats": twice(files, "path"),
        "vector id repeats": twice(chunks, "vector_id"),
        "chunk without file": chunks.join(files.select("file_id"), "file_id", "left_anti").agg(F.count("*").alias("rows")),
        "chunk without vector": chunks.join(vectors.select("vector_id"), "vector_id", "left_anti").agg(F.count("*").alias("rows")),
        "vector without chunk": vectors.select("vector_id").join(chunks.select("vector_id"), "vector_id", "left_anti").agg(F.count("*").alias("rows")),
    }
    out = None
    for name, rows in rules.items():
        own = rows.select(F.lit(name).alias("rule"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def large_hint(files: int, static_model: bool, seconds: float = 0) -> bool:
    """Whether to advise a static model: many files, or a long sync, with another kind."""
    return (files > LARGE_FILES and not static_model) or seconds > LARGE_SECONDS
