"""Versioned snapshots of an index: files, chunks, vectors and meta as Parquet, and a manifest for each version.

A table is a list of parts, each with rows and the keys whose rows in earlier parts are gone, so a sync that changes one file
writes that file's rows. Parts are merged when the later ones amount to a quarter of the first, or are too many: every row is
rewritten a bounded number of times for what is added. A version's manifest names the parts of each table. It is written under
another name and renamed to its number, and the current version is the greatest number there is: readers see the old or the new
version, never a mix, and a crash at any step leaves the old one. Any store that Spark writes will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import BROADCAST_BYTES

TABLES = ("files", "chunks", "vectors", "centres", "meta")
SCHEMAS = {
    "files": "file_id bigint, path string, last_modified bigint, size bigint, content_hash string",
    "chunks": "file_id bigint, chunk_index int, content string, start_byte bigint, end_byte bigint, node_type string, symbol string, language string, content_hash string, body_hash string, vector_id bigint",
    "vectors": "vector_id bigint, embedding array<float>, cell int",
    "centres": "cell int, centre array<double>, probes int",
    "meta": "key string, value string",
}
#: What rows are taken back by: a file's, or a vector's own.
KEYS = {"files": "file_id", "chunks": "file_id", "vectors": "vector_id"}
#: Vectors lie in a folder for each cell of the approximate index, all under UNFILED while there is none.
UNFILED = -1
#: Parts of a table, and the size of the later ones as a share of the first, from which on they are merged.
PARTS, SHARE = 16, 0.25
CELL_FILE = 100_000  # about the vectors in a file


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The current version, 0 for none."""
        return max(self._versions(), default=0)

    def manifest(self, version: int) -> dict[str, list[dict]]:
        """The parts of each table of a version: folders of rows and gone keys, and how many each has."""
        line = self._fs.open(self._path(f"{self.root}/versions/{version}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(line, "UTF-8"))
        finally:
            line.close()

    def folders(self, version: int) -> set[str]:
        return {p[x] for parts in self.manifest(version).values() for p in parts for x in ("rows", "gone") if p.get(x)}

    def read(self, name: str) -> DataFrame:
        v = self.version()
        return self._rows(name, self.manifest(v).get(name, []) if v else [])

    def count(self, name: str) -> int:
        """Rows of a table, as the manifest has them; nothing is read."""
        v = self.version()
        return sum(p["n"] - p["m"] for p in self.manifest(v).get(name, [])) if v else 0

    def _rows(self, name: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        names = [x.strip().split(" ", 1)[0] for x in SCHEMAS[name].split(", ")]
        load = lambda p: self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{p['rows']}").select(*names)
        rows, gone, key = None, None, KEYS.get(name)
        for i, p in enumerate(parts):
            own = load(p).withColumn("_part", F.lit(i))
            rows = own if rows is None else rows.unionByName(own)
            if p["gone"]:
                keys = self.spark.read.schema(f"{key} bigint").parquet(f"{self.root}/{p['gone']}").withColumn("_until", F.lit(i))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is None:
            return rows.drop("_part")
        gone = gone.groupBy(key).agg(F.max("_until").alias("_until"))
        if 32 * sum(p["k"] for p in parts) <= BROADCAST_BYTES:  # the manifest has the number of keys
            gone = F.broadcast(gone)
        return rows.join(gone, key, "left").where("_until is null or _part >= _until").select(*names)

    def _written(self, name: str, rows: DataFrame) -> tuple[str, int]:
        columns = [F.col(c).cast(t) for c, t in (x.strip().split(" ", 1) for x in SCHEMAS[name].split(", "))]
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows = rows.select(*columns)
        if name == "vectors":
            # a cell is one folder; a large one several files
            rows = rows.repartition("cell", F.floor(F.col("vector_id") / CELL_FILE))
            rows.write.partitionBy("cell").parquet(f"{self.root}/{folder}")
        else:
            rows.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}").count()

    def write(self, **tables: DataFrame) -> int:
        """Write the given tables as a new version that keeps the current version's other tables, and make it the current one.

        Of two writers of one version the first to be done wins and the other gets an error. Folders that the
        last two versions don't name are deleted afterwards.
        """
        return self.change({}, **tables)

    def change(self, changes: dict[str, tuple[DataFrame, DataFrame]], **tables: DataFrame) -> int:
        """As ``write``, and of some tables only (rows, gone): rows to add, and the keys whose present rows go first."""
        before = self.version()
        names = self.manifest(before) if before else {}
        for name, (rows, gone) in changes.items():
            old = names.get(name, [])
            folder, n = self._written(name, rows)
            part = {"rows": folder, "n": n, "gone": None, "m": 0, "k": 0}
            if old:
                key = KEYS[name]
                part["gone"] = f"data/{name}-gone-{uuid.uuid4().hex}"
                keys = gone.select(F.col(key).cast("bigint")).where(F.col(key).isNotNull()).distinct()
                keys.write.parquet(f"{self.root}/{part['gone']}")
                keys = self.spark.read.schema(f"{key} bigint").parquet(f"{self.root}/{part['gone']}")
                part["k"] = keys.count()
                if part["k"]:
                    hit = F.broadcast(keys) if 16 * part["k"] <= BROADCAST_BYTES else keys
                    part["m"] = self._rows(name, old).select(key).join(hit, key, "left_semi").count()
                else:
                    part["gone"] = None
            parts = [*old, part] if n or part["k"] or not old else old
            if len(parts) > PARTS or sum(p["n"] + p["m"] for p in parts[1:]) > SHARE * parts[0]["n"]:
                folder, n = self._written(name, self._rows(name, parts))
                parts = [{"rows": folder, "n": n, "gone": None, "m": 0, "k": 0}]
            names[name] = parts
        for name in TABLES:
            rows = tables.get(name)
            if rows is None and name in names:
                continue
            folder, n = self._written(name, self.spark.createDataFrame([], SCHEMAS[name]) if rows is None else rows)
            names[name] = [{"rows": folder, "n": n, "gone": None, "m": 0, "k": 0}]
        self._publish(before + 1, names)
        self._sweep()
        return before + 1

    def _publish(self, version: int, names: dict[str, list[dict]]) -> None:
        mine = self._path(f"{self.root}/versions/new-{uuid.uuid4().hex}")
        out = self._fs.create(mine, True)
        out.write(bytearray(json.dumps(names).encode()))
        out.close()
        target = self._path(f"{self.root}/versions/{version}")
        if self._fs.exists(target) or not self._fs.rename(mine, target):
            self._fs.delete(mine, False)
            raise OSError(f"version {version} is there already")

    def _sweep(self) -> None:
        versions = self._versions()
        for v in versions[:-2]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}"), False)
        named = set().union(*(self.folders(v) for v in versions[-2:]))
        for x in self._fs.listStatus(self._path(f"{self.root}/data")):
            if f"data/{x.getPath().getName()}" not in named:
                self._fs.delete(x.getPath(), True)

    def dims(self) -> int | None:
        """Width of the stored vectors, as the first of them has it; None without any."""
        row = self.read("vectors").select(F.size("embedding")).first()
        return row[0] if row else None

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").collect()}

    def wipe(self) -> None:
        """Delete the index; fine if there is none, an error if something stays."""
        self._fs.delete(self._path(self.root), True)
        if self._fs.exists(self._path(self.root)):
            raise OSError(f"{self.root} can't be deleted")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` less those whose key is in ``gone``; keys that aren't there are fine."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def with_meta(meta: DataFrame, spark: SparkSession, **values: str) -> DataFrame:
    new = spark.createDataFrame([(k, v) for k, v in values.items()], "key string, value string")
    return without(meta, new, "key").unionByName(new)
