"""Incremental sync: a scan against the last snapshot, as joins.

``scan``: path, last_modified (seconds), size, text (null if unreadable or not text). ``files``: file_id, path,
last_modified, size, content_hash. ``chunks``: file_id, chunk_index, content, start_byte, end_byte,
node_type, language, content_hash, body_hash, vector_id. The plan reads the last snapshot only, so what
one file of a pass brings can't disturb another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, embed_header
from ..tables import durable

CHUNKER_VERSION = "1"
FIRST_ID = 1


def first_of_path(scan: DataFrame) -> DataFrame:
    """One row a path: of several the one with the least (last_modified, size)."""
    order = Window.partitionBy("path").orderBy("last_modified", "size")
    return scan.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def by_stat(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Scan rows with file_id and _hash of the last snapshot, and _same: same time and size, unless forced."""
    known = files.select("path", "file_id", F.col("last_modified").alias("_mtime"), F.col("size").alias("_size"), F.col("content_hash").alias("_hash"))
    same = (F.col("last_modified") == F.col("_mtime")) & (F.col("size") == F.col("_size")) & F.lit(not force)
    return first_of_path(scan).join(known, "path", "left").withColumn("_same", F.coalesce(same, F.lit(False))).drop("_mtime", "_size")


def judged(rows: DataFrame, force: bool = False) -> DataFrame:
    """Rows of ``by_stat`` that also have text, with file_hash and class in place of _hash and _same."""
    # the text of a row that is the same by stat is not hashed
    rows = rows.withColumn("file_hash", F.when(~F.col("_same"), digest(F.col("text"))))
    kind = F.when(F.col("_same") | F.col("text").isNull() | (F.col("text") == ""), "unchanged").when(F.col("file_hash") == F.col("_hash"), F.lit("changed" if force else "touched")).otherwise("changed")
    return rows.withColumn("class", kind).drop("_hash", "_same")


def classified(scan: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Scan rows with file_hash, file_id and class: unchanged, touched or changed.

    Same time and size (unless forced), or no text: unchanged; the same hash: touched; else changed.
    """
    return judged(by_stat(scan, files, force), force)


def deleted(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that the scan doesn't have."""
    return files.join(scan.select("path").distinct(), "path", "left_anti")


def hashed_chunks(chunks: DataFrame) -> DataFrame:
    """New chunks (path, chunk_index, content, node_type, symbol) with content_hash and body_hash."""
    header = embed_header(F.col("path"), F.col("symbol"), F.col("node_type"), F.col("content"))
    return chunks.withColumns({"content_hash": digest(F.concat(header, "content")), "body_hash": digest(F.col("content"))})


def reuse_plan(fresh: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Where each new chunk's vector comes from: adds reuse (same, copy, fresh) and source_id.

    ``same``: a chunk of the file's last state with the same content_hash, each used once and the last first;
    ``copy``: the least vector of any chunk with the same body_hash; ``fresh``: to be embedded.
    A hash that a third of all chunks share is one row on the side it is looked up in.
    """
    alive = chunks.join(vectors.select("vector_id"), "vector_id", "left_semi")
    old = chunks.join(files.select("file_id", "path"), "file_id")
    order = Window.partitionBy("path", "content_hash")
    old = old.select("path", "content_hash", F.col("vector_id").alias("same_id"), F.row_number().over(order.orderBy(F.desc("chunk_index"), F.desc("vector_id"))).alias("_n"))
    rows = fresh.withColumn("_n", F.row_number().over(order.orderBy("chunk_index"))).join(old, ["path", "content_hash", "_n"], "left").drop("_n")
    copies = alive.groupBy("body_hash").agg(F.min("vector_id").alias("copy_id"))
    rows = rows.join(copies, "body_hash", "left")
    return rows.withColumns({
        "reuse": F.when(F.col("same_id").isNotNull(), "same").when(F.col("copy_id").isNotNull(), "copy").otherwise("fresh"),
        "source_id": F.coalesce("same_id", "copy_id"),
    }).drop("same_id", "copy_id")


def orphans(plan: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of replanned files that no new chunk claims: vector_id."""
    old = chunks.join(files.select("file_id", "path"), "file_id").join(plan.select("path").distinct(), "path", "left_semi")
    claimed = plan.where("reuse = 'same'").select(F.col("source_id").alias("vector_id"))
    return old.select("vector_id").join(claimed, "vector_id", "left_anti")


def allocated(plan: DataFrame, next_id: int) -> DataFrame:
    """Plan rows with vector_id: that of ``same``, else a new one, contiguous by path and chunk_index."""
    new = plan.where("reuse <> 'same'")
    order = Window.partitionBy("path").orderBy("chunk_index")
    # how many new chunks stand in earlier paths: paths are sorted in ranges, and only a count for each range is summed in one place
    per_path = durable(new.groupBy("path").agg(F.count("*").alias("_n")).repartitionByRange("path").withColumn("_part", F.spark_partition_id()))
    parts = per_path.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    parts = parts.select("_part", (F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + next_id).alias("_first"))
    own = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per_path.withColumn("_own", own).join(parts, "_part").select("path", (F.col("_first") + F.col("_own")).alias("_base"))
    fresh = new.withColumn("_k", F.row_number().over(order) - 1).join(base, "path").withColumn("vector_id", F.col("_base") + F.col("_k")).drop("_base", "_k")
    return plan.where("reuse = 'same'").withColumn("vector_id", F.col("source_id")).unionByName(fresh)


def merkle_root(files: DataFrame) -> DataFrame:
    """One row: root, the digest of a tree over all files.

    A file's line (path NUL hash newline) belongs to one of 4,096 leaves by the digest of its path; a leaf's digest is over its
    lines in path order, and the root's over the leaves in order. So a task gathers a leaf's lines, not all.
    """
    line = F.concat(F.col("path"), F.lit("\x00"), F.col("content_hash"), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    leaves = files.groupBy(F.left(digest(F.col("path")), F.lit(3)).alias("bucket")).agg(digest(F.array_join(lines, "")).alias("leaf"))
    top = F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.concat("bucket", "leaf", F.lit("\n")).alias("line")))), lambda x: x["line"])  # 4,096 at most
    return leaves.agg(digest(F.array_join(top, "")).alias("root"))


def fingerprint(model: str, dims: int, max_length: int, cap: int, contract: str, version: str = CHUNKER_VERSION) -> str:
    return f"v{version}|{model}|{dims}|{max_length}|{cap}|{contract}"


def stats(classes: DataFrame, gone: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: files_indexed, files_skipped, files_deleted, chunks_total."""
    seen = classes.agg(F.count(F.when(F.col("class") == "changed", 1)).alias("files_indexed"), F.count(F.when(F.col("class") != "changed", 1)).alias("files_skipped"))
    return seen.crossJoin(gone.agg(F.count("*").alias("files_deleted"))).crossJoin(plan.agg(F.count("*").alias("chunks_total")))  # one row each


def short_root(root: Column) -> Column:
    return F.left(root, F.lit(16))
