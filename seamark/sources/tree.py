"""Source trees: which files count, and their rows.

Paths are walked on the driver, as ignore rules need the order of folders; stats and contents are read by
executors. A tree on a shared store is read by ``scan_store`` instead, whose rules are column expressions.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import is_text
from ..tables import if_small

INDEX_DIR = ".seamark"
# Folders that hold no sources.
EXCLUDED_DIRS = (INDEX_DIR, "target", "node_modules", ".venv", "venv", "env", ".env", "__pycache__", "dist", "build", ".git", ".svn", ".hg")
SNIFF = 8192
STAT = "path string, last_modified bigint, size bigint"
SCAN = f"{STAT}, text string"
#: Files whose contents are held at once, and the most files that are opened by name on a store.
READ_ROWS, NAMED = 64, 10_000


def is_excluded(path: Column, dirs: tuple[str, ...] = EXCLUDED_DIRS, parts: tuple[str, ...] = ()) -> Column:
    """Whether a relative path lies in an excluded folder, is a lock file, or has a configured part in it."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(x) for x in dirs))) | path.endswith(".lock")
    for part in parts:
        if part:
            out = out | path.contains(part)
    return out


def excluded(path: str, dirs: tuple[str, ...] = EXCLUDED_DIRS, parts: tuple[str, ...] = ()) -> bool:
    return bool(set(path.split("/")) & set(dirs)) or path.endswith(".lock") or any(p and p in path for p in parts)


class IgnoreRules:
    """The patterns of one ignore file, for paths relative to its folder."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].replace("\\#", "#").replace("\\!", "!")
            only_dir, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            out, i = "", 0
            line = line.lstrip("/")
            while i < len(line):
                if line.startswith("**/", i):
                    out, i = out + "(?:.*/)?", i + 3
                elif line.startswith("**", i):
                    out, i = out + ".*", i + 2
                elif line[i] == "*":
                    out, i = out + "[^/]*", i + 1
                elif line[i] == "?":
                    out, i = out + "[^/]", i + 1
                elif line[i] == "[" and "]" in line[i + 2 :]:
                    end = line.index("]", i + 2)
                    out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
                else:
                    i += line[i] == "\\" and i + 1 < len(line)
                    out, i = out + re.escape(line[i]), i + 1
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), only_dir, keep))

    def says(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept again; None: no rule fits. The last rule that fits decides."""
        said = None
        for form, only_dir, keep in self.rules:
            if (is_dir or not only_dir) and form.match(path):
                said = not keep
        return said


def linked_worktrees(root: Path) -> list[Path]:
    """Roots of linked worktrees that lie within the project."""
    found = []
    for f in sorted(root.glob(".git/worktrees/*/gitdir")):
        try:
            tree = Path(f.read_text().strip()).parent.resolve()
        except OSError:
            continue
        if tree != root.resolve() and tree.is_relative_to(root.resolve()):
            found.append(tree)
    return found


def collect_files(root: str | Path, dirs: tuple[str, ...] = EXCLUDED_DIRS, parts: tuple[str, ...] = ()) -> list[str]:
    """Relative paths of all files that count, sorted; hidden ones too, ignore files honoured at each level.

    A symbolic link counts only if no other path has its target already; real files come first.
    """
    root = Path(root).resolve()
    trees = set(linked_worktrees(root))
    outer: list[tuple[Path, IgnoreRules]] = []
    for folder in reversed([*root.parents]):  # ignore files of the folders above, from the repository's top
        if (folder / ".gitignore").is_file() and any((p / ".git").exists() for p in [folder, *folder.parents]):
            outer.append((folder, IgnoreRules((folder / ".gitignore").read_text(errors="replace"))))
    real, links = [], []

    def walk(folder: Path, rules: list[tuple[Path, IgnoreRules]]) -> None:
        for name in (".gitignore", ".ignore"):
            if (folder / name).is_file():
                rules = [*rules, (folder, IgnoreRules((folder / name).read_text(errors="replace")))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            path = Path(entry.path)
            rel = path.relative_to(root).as_posix()
            is_dir = entry.is_dir(follow_symlinks=False)
            said = None
            for top, own in rules:
                answer = own.says(path.relative_to(top).as_posix(), is_dir)
                said = said if answer is None else answer
            if said or excluded(rel, dirs, parts):
                continue
            if is_dir:
                if path not in trees:
                    walk(path, rules)
            elif entry.is_symlink():
                if path.is_file():
                    links.append(path)
            elif entry.is_file(follow_symlinks=False):
                real.append(path)

    walk(root, outer)
    seen, out = {p.resolve() for p in real}, [*real]
    for link in sorted(links):
        if (target := link.resolve()) not in seen:
            seen.add(target)
            out.append(link)
    return sorted(p.relative_to(root).as_posix() for p in out)


def read_text(path: Path) -> str | None:
    """A file's text; None if unreadable or not text."""
    try:
        raw = path.read_bytes()
    except OSError:
        return None
    if b"\0" in raw[:SNIFF] or b"\0" in raw:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def stat_of(path: Path) -> tuple[int, int]:
    """Seconds of the last change and size; zeros where they can't be had."""
    try:
        s = path.stat()
    except OSError:
        return 0, 0
    return int(s.st_mtime), s.st_size


def scan_tree(spark: SparkSession, root: str | Path) -> DataFrame:
    """Path, time and size of the files of a local tree; no content is read."""
    root = Path(root).resolve()
    paths = collect_files(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    top = str(root)

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            stats = [stat_of(Path(top) / p) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "last_modified": [s[0] for s in stats], "size": [s[1] for s in stats]})

    return listed.repartition(len(paths) // 1024 + 1).mapInPandas(look, STAT)


def with_tree_texts(asked: DataFrame, root: str | Path) -> DataFrame:
    """``asked`` (path and any other columns, a written table) with text: null if unreadable or not text.

    Only paths are dealt out; contents go from the file to the row, READ_ROWS files at a time.
    """
    top, names = str(Path(root).resolve()), [*asked.columns, "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(k, READ_ROWS)
                texts = [read_text(Path(top) / p) for p in part.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return asked.repartition(asked.count() // 128 + 1).mapInArrow(read, StructType([*asked.schema.fields, StructField("text", StringType())]))


def _store_files(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """path, last_modified, size and text of the files below ``root``, or of those named in it.

    ``content`` is only read where ``text`` is selected: time and size alone don't need it.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        files = reader.option("recursiveFileLookup", "true").load(root)
    else:
        files = reader.load([root.rstrip("/") + "/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in only])
    top = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    path = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), {len(top) + 2})")
    text = F.when(is_text(F.col("content")), F.col("content").cast("string"))
    return files.select(path.alias("path"), F.unix_seconds("modificationTime").alias("last_modified"), F.col("length").alias("size"), text.alias("text"))


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """Rows of ``SCAN`` for a tree on any store that Spark reads, by fixed exclusions."""
    return _store_files(spark, root).where(~is_excluded(F.col("path")))


def with_store_texts(asked: DataFrame, root: str) -> DataFrame:
    """As ``with_tree_texts`` for a tree on a store; files that are gone by now have no row.

    Up to NAMED files are opened by name; for more the tree is scanned and joined, and nothing is gathered.
    """
    some = [r.path for r in asked.select("path").limit(NAMED + 1).collect()]
    if not some:
        return asked.withColumn("text", F.lit(None).cast("string"))
    try:
        files = _store_files(asked.sparkSession, root, some if len(some) <= NAMED else None)
    except AnalysisException:  # one of them is gone
        files = _store_files(asked.sparkSession, root)
    return files.select("path", "text").join(if_small(asked), "path").select(*asked.columns, "text")


def git_top(folder: Path) -> Path | None:
    try:
        said = subprocess.run(["git", "-C", str(folder), "rev-parse", "--show-toplevel"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return Path(said.stdout.strip()) if said.returncode == 0 and said.stdout.strip() else None


def project_root(requested: str | None = None, named: str | None = None, cwd: str | None = None, home: str | None = None, lookup: Callable[[Path], Path | None] = git_top) -> Path:
    """The tree to index: as requested, else named by the environment, else the repository's top, else here.

    The root folder, the home folder and what lies above it are refused; without a home only a repository will do.
    """
    here = Path(cwd or os.getcwd())
    chosen = Path(requested) if requested else Path(named) if named else lookup(here) or here
    chosen = chosen.resolve()
    if chosen == Path(chosen.anchor):
        raise ValueError("the root folder is not a project")
    if home:
        top = Path(home).resolve()
        if chosen == top or top.is_relative_to(chosen):
            raise ValueError(f"{chosen} is the home folder or lies above it; name a folder below")
    elif lookup(chosen) is None:
        raise ValueError(f"{chosen} is in no repository, and there is no home folder to judge it by")
    return chosen
