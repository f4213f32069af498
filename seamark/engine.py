"""The engine: keeps an index of a tree in step and answers searches over it."""

from __future__ import annotations

import os
import time
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import embed_header, norm_scope
from .functions.vector import stub_vector
from .operators import ann, inspect, search, sync
from .operators.chunk import chunk_files
from .operators.embed import embedded
from .sources import settings as cfg
from .sources.store import UNFILED, Store, with_meta, without
from .sources.tree import INDEX_DIR, project_root, scan_store, scan_tree, with_store_texts, with_tree_texts
from .tables import durable, tidy

STUB = cfg.ModelSpec("stub", 64, 0, 0, 0, None, None, "mean", True, 64, 448, False, "deterministic, for tests")


class Engine:
    """``embed``: None for stub vectors, else a function that loads a model and returns texts -> vectors."""

    def __init__(self, spark: SparkSession, root: str, index: str | None = None, settings: dict | None = None, spec: cfg.ModelSpec = STUB, embed=None, rerank=None, home: str | None = None) -> None:
        self.spark, self.remote = spark, "://" in root
        self.root = root if self.remote else str(project_root(root, home=home or os.path.expanduser("~")))
        self.settings = settings or (cfg.DEFAULTS if self.remote else cfg.load(cfg.global_config(home), f"{self.root}/{INDEX_DIR}/config.toml"))
        self.spec, self.embed, self.rerank = spec, embed, rerank
        self.store = Store(spark, index or f"{self.root}/{INDEX_DIR}/index")
        self.cap = self.settings["sync"]["max_chunk_bytes"]
        self.mark = sync.fingerprint(spec.name, spec.dimensions, self.settings["model"]["max_length"], self.cap, spec.contract())
        meta = self.store.meta()
        if meta and (meta.get("index_fingerprint") != self.mark or (self.store.dims() or spec.dimensions) != spec.dimensions):
            self.store.wipe()  # another model or chunker: what is there can't be compared

    def _vectors(self, rows: DataFrame, text: str, prefix: str | None) -> DataFrame:
        if self.embed is None:
            whole = F.concat(F.lit(prefix or ""), F.col(text))
            return rows.withColumn("embedding", stub_vector(whole, self.spec.dimensions).cast("array<float>"))
        batch = cfg.batch_size(self.settings["sync"]["embed_batch_size"], self.spec)
        return embedded(rows, text, "embedding", self.embed, batch, prefix)

    def scan(self) -> DataFrame:
        """Path, time and size of all files; no content is read."""
        found = scan_store(self.spark, self.root) if self.remote else scan_tree(self.spark, self.root)
        return found.select("path", "last_modified", "size")

    def with_texts(self, asked: DataFrame) -> DataFrame:
        """``asked`` (path and any other columns, a written table) with the texts of these files."""
        return with_store_texts(asked, self.root) if self.remote else with_tree_texts(asked, self.root)

    @tidy
    def sync(self, force: bool = False) -> dict:
        """Bring the index in step with the tree; one new version if anything changed.

        Contents are read only of files with another time or size than in the last snapshot, and once.
        """
        began = time.time()
        read = self.store.read
        files, chunks, vectors, meta = (read(x) for x in ("files", "chunks", "vectors", "meta"))
        said = self.store.meta()
        seen = durable(sync.by_stat(self.scan(), files, force))
        same = seen.where("_same").withColumn("text", F.lit(None).cast("string"))
        classes = durable(sync.judged(self.with_texts(seen.where("not _same")).unionByName(same), force))
        gone = durable(sync.deleted(seen, files))
        changed, touched = classes.where("class = 'changed'"), classes.where("class = 'touched'")
        kinds = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}  # three at most
        stats = {"files_indexed": kinds.get("changed", 0), "files_skipped": kinds.get("unchanged", 0) + kinds.get("touched", 0), "files_deleted": gone.count(), "chunks_total": 0}
        if stats["files_indexed"]:
            fresh = durable(sync.hashed_chunks(chunk_files(changed.select("path", "text"), self.cap)))
            plan = durable(sync.allocated(sync.reuse_plan(fresh, files, chunks, vectors), int(said.get("next_vector_id", sync.FIRST_ID))))
            stats["chunks_total"] = plan.count()
        else:
            plan = chunks.where("false").drop("file_id").withColumns({"path": F.lit(""), "reuse": F.lit(""), "source_id": F.lit(0).cast("bigint")})
        if not self.store.version() or stats["files_indexed"] or stats["files_deleted"] or kinds.get("touched"):
            self._apply(files, chunks, vectors, meta, said, changed, touched, gone, plan)
            self._file_vectors()
        else:
            self.store.write(meta=with_meta(meta, self.spark, last_sync_at=_now()))  # nothing else is written
        return stats | {"elapsed_ms": int((time.time() - began) * 1000)}

    def _apply(self, files, chunks, vectors, meta, said, changed, touched, gone, plan) -> None:
        # file ids: kept by path, new ones above all that were ever given
        new_paths = changed.where("file_id is null").select("path", F.lit(0).alias("chunk_index"), F.lit("fresh").alias("reuse"), F.lit(None).cast("bigint").alias("source_id"))
        ids = sync.allocated(new_paths, int(said.get("next_file_id", 1))).select("path", F.col("vector_id").alias("new_id"))
        rows = durable(changed.join(ids, "path", "left").select(F.coalesce("file_id", "new_id").alias("file_id"), "path", "last_modified", "size", F.col("file_hash").alias("content_hash")))
        stamped = touched.join(files.select("path", "content_hash"), "path").select("file_id", "path", "last_modified", "size", "content_hash")
        new = durable(stamped.unionByName(rows))
        lost = durable(gone.select("file_id").unionByName(changed.where("file_id is not null").select("file_id")))  # files whose chunks go
        files_gone = lost.unionByName(stamped.select("file_id"))
        planned = plan.join(rows.select("path", "file_id"), "path")
        ask = planned.where("reuse = 'fresh'").select("vector_id", F.col("path").alias("_p"), "symbol", "node_type", "content")
        ask = ask.select("vector_id", F.concat(embed_header(F.col("_p"), F.col("symbol"), F.col("node_type"), F.col("content")), "content").alias("whole"))
        made = self._vectors(ask, "whole", self.spec.doc_prefix).select("vector_id", "embedding")
        reused = planned.where("reuse <> 'fresh'").select("vector_id", "source_id").join(vectors.withColumnRenamed("vector_id", "source_id"), "source_id").select("vector_id", "embedding")
        vectors_gone = chunks.select("file_id", "vector_id").join(lost, "file_id", "left_semi").select("vector_id")
        centres, _ = self._cells()
        added = self._filed(durable(reused.unionByName(made)), centres)
        next_id = max(int(said.get("next_vector_id", sync.FIRST_ID)), (plan.agg(F.max("vector_id")).first()[0] or 0) + 1)
        next_file = max(int(said.get("next_file_id", 1)), (rows.agg(F.max("file_id")).first()[0] or 0) + 1)
        root = sync.merkle_root(without(files, files_gone, "file_id").unionByName(new.select(*files.columns))).first()[0]
        marks = with_meta(meta, self.spark, schema_version="1", model_name=self.spec.name, dimensions=str(self.spec.dimensions), index_fingerprint=self.mark, next_vector_id=str(next_id), next_file_id=str(next_file), merkle_root=root, last_sync_at=_now())
        changes = {"files": (new, files_gone), "chunks": (planned.select(*chunks.columns), lost), "vectors": (added, vectors_gone)}
        self.store.change(changes, meta=marks)

    def _cells(self) -> tuple[np.ndarray | None, int]:
        """Centres of the approximate index and how many cells a search probes; None while search is exact."""
        rows = sorted(self.store.read("centres").collect(), key=lambda r: r.cell) if self.store.count("centres") else []  # at most ann.MOST_CELLS
        return (np.array([r.centre for r in rows], np.float64), rows[0].probes) if rows else (None, 0)

    def _filed(self, vectors: DataFrame, centres: np.ndarray | None) -> DataFrame:
        """``vectors`` with the cell of each; a search reads those without one always."""
        loose = vectors.withColumn("cell", F.lit(UNFILED))
        if centres is None:
            return loose
        return ann.assigned(vectors, centres).unionByName(loose.where("embedding is null"))

    def _file_vectors(self) -> None:
        """File the vectors under cells once there are exact_below of them, anew when they have doubled; below, search is exact."""
        n, centres = self.store.count("vectors"), self.store.count("centres")
        fitted = int(self.store.meta().get("cells_fitted_at", 0))
        if ann.backend(n, self.settings["search"]["exact_below"]) == "exact":
            if centres:
                self.store.write(centres=self.store.read("centres").where("false"))
            return
        if centres and n < 2 * fitted:
            return
        vectors = self.store.read("vectors").select("vector_id", "embedding")
        sample = ann.sampled(vectors)
        found = ann.fit_centres(sample, ann.cells_for(n))
        probes = ann.probes_for(sample, found, ann.RECALL, k=max(10, search.LEAST_FETCH * len(sample) // n))
        rows = self.spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(found)], "cell int, centre array<double>, probes int")
        marks = with_meta(self.store.read("meta"), self.spark, cells_fitted_at=str(n))
        self.store.write(vectors=self._filed(vectors, found), centres=rows, meta=marks)

    def _index(self) -> tuple[DataFrame, DataFrame]:
        files, chunks = self.store.read("files"), self.store.read("chunks")
        return chunks.join(files.select("file_id", F.col("path").alias("file_path")), "file_id"), self.store.read("vectors")

    def search(self, text: str, limit: int = 10, scope: str | None = None) -> list[dict]:
        """The best chunks for one text, as result rows in order."""
        return [r for _, r in self.search_many([text], limit, scope)]

    @tidy
    def search_many(self, texts: list[str], limit: int = 10, scope: str | None = None) -> list[tuple[int, dict]]:
        scope = self.spark.range(1).select(norm_scope(F.lit(scope or ""))).first()[0]
        asked = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid bigint, text string")
        asked = durable(self._vectors(asked, "text", self.spec.query_prefix).withColumnRenamed("embedding", "vector"))
        chunks, vectors = self._index()
        rerank = self.rerank if cfg.rerank_enabled(self.settings, self.spec) else None
        centres, probes = self._cells()
        if centres is not None:
            near = ann.probed(asked, centres, probes)
            vectors = vectors.where(F.col("cell").isin([UNFILED, *near]))  # a folder a cell: the others aren't read
        ordered = durable(search.hybrid_search(chunks, vectors, asked, limit, scope or None, rerank).select("qid", "vector_id", "score", "ord"))
        hit = durable(ordered.where(F.col("ord") < limit).join(chunks.select("vector_id", F.col("file_path").alias("path")), "vector_id").select("path").distinct())
        found = search.results(ordered, chunks, self.with_texts(hit), limit).orderBy("qid", "ord").collect()
        return [(r.qid, r.asDict(recursive=True)) for r in found]

    def status(self) -> dict:
        now: Column = F.current_timestamp()
        s = self.settings
        return inspect.status(*(self.store.read(x) for x in ("files", "chunks", "vectors", "meta")), now, s["sync"]["resync_interval_minutes"], "cells" if self.store.count("centres") else "exact").first().asDict()

    def is_due(self) -> bool:
        return self.status()["resync_due"]

    def list_files(self) -> DataFrame:
        return inspect.list_files(self.store.read("files"), self.store.read("chunks"))

    def chunks_for_file(self, path: str) -> DataFrame:
        return inspect.chunks_for_file(self.store.read("files"), self.store.read("chunks"), path)


def _now() -> str:
    return datetime.now(UTC).isoformat()
