"""N-gram Jaccard self-join by a MinHash LSH forest.

Each text's five-word shingles give TREES labels of DEPTH one-byte MinHash values. A tree's labels make a prefix
trie. A label's matched prefix is shortened as far as its node stays a leaf of LEAF texts at most, down to SHORTEST values,
and it is never longer than ``depth_for`` the target: at that length pairs at the threshold meet in some tree with the target
probability, so a node there is a leaf whatever its size. Where nodes are small, which depends on the corpus, prefixes are shorter
and the recall is higher: 0.9982 of pairs at 0.8 with five values, 0.99999 with three.

Texts in one leaf are compared by all TREES * DEPTH values, those clearly below the threshold part again, and what
remains connected is verified exactly, all pairs. For that a text is told by how its shingles differ from those of one text of
its component, and only these differences are dealt out in blocks of bounded size. Only link counts and a spanning
forest leave a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import durable, if_small, table, tidy
from .graph import components

TREES, DEPTH = 16, 8
THRESHOLD, TARGET = 0.8, 0.995
#: Standard errors below the threshold at which a MinHash estimate parts two texts.
MARGIN = 5.0
#: A node of the trie with so many texts isn't split; a prefix has so many values at least.
LEAF, SHORTEST = 8, 3
#: Texts compared at once by their values, and exactly; a larger group is dealt out as pairs of blocks of half as many.
BLOCK, EXACT_BLOCK = 512, 256
#: Differing shingles, about, in the texts that are compared exactly at once.
BLOCK_SHINGLES = 2_000_000
_L = [f"l{t}" for t in range(TREES)]
_rng = np.random.Generator(np.random.PCG64(303))
_A = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
SIGNED = "doc_id bigint, h1 bigint, h2 bigint, n bigint, " + ", ".join(f"{x} bigint" for x in _L)


def depth_for(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability."""
    depth = DEPTH
    while depth > 1 and recall(depth, threshold) < target:
        depth -= 1
    return depth


def recall(depth: int, similarity: float) -> float:
    """The probability that two texts share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def minhash(shingle: np.ndarray) -> np.ndarray:
    """One byte of each of the TREES * DEPTH minima."""
    low = np.full(len(_A), 2**64 - 1, np.uint64)
    for k in range(0, len(shingle), 2048):
        part = shingle[None, k : k + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (kernels.mix(low) >> np.uint64(56)).astype(np.uint8)


def set_hash(shingle: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of distinct shingles."""
    one, two = kernels.mix(shingle).sum(dtype=np.uint64), kernels.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    both = kernels.mix(np.array([one, two], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            shingle, first = kernels.shingles(*kernels.words(part.column(1)))
            rows = part.num_rows
            sums, n, labels = np.zeros((rows, 2), np.int64), np.zeros(rows, np.int64), np.zeros((rows, TREES), np.int64)
            for d in range(rows):
                own = np.unique(shingle[first[d] : first[d + 1]])
                n[d] = len(own)
                if len(own):
                    sums[d] = set_hash(own)
                    labels[d] = minhash(own).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array(n), *(pa.array(labels[:, t].copy()) for t in range(TREES))], names=["doc_id", "h1", "h2", "n", *_L])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, one run at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = np.stack([np.asarray(batch.column(k)) for k in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[a].tolist())
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, linked: np.ndarray) -> None:
        """``linked`` is a square of booleans."""
        for x in range(len(linked)):
            for y in np.flatnonzero(linked[x, :x]).tolist():
                a, b = self.root(x), self.root(y)
                if a != b:
                    self.up[max(a, b)] = min(a, b)


def _cross(own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs a task of blocks i and j compares: of the same block, or across two."""
    return np.ones((len(own), len(own)), bool) if i == j else own[:, None] != own[None, :]


def _likely(threshold: float):
    least = threshold - MARGIN * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: key, i, j, block, node, labels; a spanning forest of what may be similar leaves."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for group in _groups(batches, 3):
            node = np.asarray(group.column(4))
            n = len(node)
            values = np.stack([np.asarray(group.column(5 + t)) for t in range(TREES)], 1).astype(">i8").view(np.uint8).reshape(n, -1)
            same = np.zeros((n, n), np.uint8)
            for k in range(values.shape[1]):
                same += values[:, k][:, None] == values[:, k][None, :]
            linked = (same >= least * values.shape[1]) & _cross(np.asarray(group.column(3)), group.column(1)[0].as_py(), group.column(2)[0].as_py())
            np.fill_diagonal(linked, False)
            forest = _Forest(n)
            forest.join(linked)
            root = np.array([forest.root(x) for x in range(n)])
            keep = root != np.arange(n)
            if keep.any():
                out.append((node[keep], node[root[keep]]))
                waiting += int(keep.sum())
            if waiting >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], names=["a", "b"])
                out, waiting = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(2)], names=["a", "b"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections of arrays of distinct values."""
    n, size = len(sets), np.array([len(s) for s in sets])
    values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[which]
    owner, column = owner[use], number[which[use]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        x = np.zeros((n, min(columns, int(shared.sum()) - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: node, h1, h2, text; the shingles of texts that are those of their class."""
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            shingle, first = kernels.shingles(*kernels.words(part.column(3)))
            own = [np.unique(shingle[first[d] : first[d + 1]]) for d in range(part.num_rows)]
            # a row whose text isn't that of its class repeats an id
            good = [d for d, (x, one, two) in enumerate(zip(own, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)) if len(x) and set_hash(x) == (one, two)]
            sizes = np.cumsum([0, *(len(own[d]) for d in good)])
            values = np.concatenate([own[d] for d in good]) if good else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good, pa.int64())), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.view(np.int64)))], names=["node", "s"])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: comp, i, j, block, node, docs, size, common, more, less: two texts share common - less - less' + (less in both) + (more in both)."""
        ready: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for group in _groups(batches, 3):
            own, node, docs, size, common = (np.asarray(group.column(k)) for k in range(3, 8))
            if len(node) < 2:
                continue
            more, less = _lists(group.column(8)), _lists(group.column(9))
            gone = np.array([len(x) for x in less], np.float64)
            both = common[0] - gone[:, None] - gone[None, :] + intersections(more) + intersections(less)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            linked &= _cross(own, group.column(1)[0].as_py(), group.column(2)[0].as_py())
            np.fill_diagonal(linked, False)
            forest = _Forest(len(node))
            forest.join(linked)
            root = node[[forest.root(x) for x in range(len(node))]]
            ready.append((node, linked.sum(axis=1), linked @ docs, root))
            waiting += len(node)
            if waiting >= 10_000:
                yield flush(ready)
                ready, waiting = [], 0
        if ready:
            yield flush(ready)

    def flush(ready: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in ready]).astype(np.int64)) for k in range(4)], names=["node", "links", "link_docs", "root"])

    return run


def in_blocks(members: DataFrame, key: str, node: str, count: str, most: int, weight: str | None = None) -> DataFrame:
    """Deal each group out as pairs of blocks of about ``most`` / 2 members: adds i, j (i <= j) and block.

    A group of up to ``most`` members (and up to BLOCK_SHINGLES of ``weight``, the group's) is one block; each pair of members
    of a larger one meets in one pair of blocks.
    """
    size = F.greatest(F.col(count) / most, F.col(weight) / BLOCK_SHINGLES) if weight else F.col(count) / most
    blocks = F.when(size <= 1, F.lit(1)).otherwise(F.ceil(2 * size)).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(9)), F.col("_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    dealt = members.withColumn("_blocks", blocks).withColumn("block", own).withColumn("_other", F.explode(others))
    return dealt.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_blocks", "_other")


def leaves(classes: DataFrame, longest: int) -> DataFrame:
    """node, key and size: the texts in each leaf of the tries with more than one text.

    The tries are walked from prefixes of SHORTEST values on: a node of one text matches nothing, one of up to LEAF texts is
    a leaf, and the texts of a larger one go on with a longer prefix, up to ``longest`` values. A node's texts are counted, never gathered.
    """
    live = classes.select("node", F.posexplode(F.array(*_L)).alias("tree", "label"))
    found = None
    for depth in range(min(SHORTEST, longest), longest + 1):
        live = live.withColumn("prefix", F.shiftright("label", 8 * (DEPTH - depth)))
        shared = durable(live.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1"))
        live = durable(live.join(if_small(shared), ["tree", "prefix"]))
        leaf = live if depth == longest else live.where(F.col("size") <= LEAF)
        own = leaf.select("node", F.xxhash64("tree", F.lit(depth), "prefix").alias("key"), "size")
        found = own if found is None else found.unionByName(own)
        live = live.where(F.col("size") > LEAF).select("node", "tree", "label")
    return found


@tidy
def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Join ``docs`` (doc_id, text) with itself on shingle Jaccard similarity of ``threshold`` or more.

    Texts with equal sets of shingles are one class, named by its least doc_id (class_id). One row a row
    of ``docs``: doc_id, class_id, class_docs, n_links (other documents, copies included, that it is
    similar to), class_links (other classes that its class is similar to) and group_id (least
    class_id among those connected by links). Null, empty and wordless texts and rows with a null
    doc_id are classes and groups of their own without links, with their doc_id as name. Repeated rows count as
    documents of their class; ties go to the least doc_id; a very long text is handled alone; an empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = durable(docs.mapInArrow(_sign, SIGNED))
    some = signed.where("n > 0 and doc_id is not null")
    # written before it is used, so that a class keeps its number
    classes = durable(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs"), *(F.min(x).alias(x) for x in _L)).withColumn("node", F.monotonically_increasing_id()))
    members = durable(leaves(classes, depth_for(threshold, target)))
    labelled = members.join(if_small(durable(members.select("node").distinct().join(classes.select("node", *_L), "node"))), "node")
    dealt = in_blocks(labelled, "key", "node", "size", BLOCK).select("key", "i", "j", "block", "node", *_L)
    likely = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_likely(threshold), "a bigint, b bigint")
    comps = durable(components(likely))
    asked = durable(comps.join(classes.select("node", "h1", "h2", F.col("class_id").alias("doc_id")), "node").select("node", "h1", "h2", "doc_id"))
    texts = docs.where("text is not null").join(if_small(asked), "doc_id").select("node", "h1", "h2", "text")
    sets = durable(texts.mapInArrow(_sets, "node bigint, s array<bigint>").dropDuplicates(["node"]))
    # differences from the text that names the component
    roots = durable(comps.where("node = root").select("node").join(sets, "node").select(F.col("node").alias("root"), F.col("s").alias("common")))
    told = comps.join(classes.select("node", "class_docs"), "node").join(sets, "node").join(if_small(roots), "root")
    told = durable(told.select(F.col("root").alias("comp"), "node", "class_docs", F.size("s").cast("bigint").alias("n"), F.size("common").cast("bigint").alias("common"), F.array_except("s", "common").alias("more"), F.array_except("common", "s").alias("less")))
    sizes = durable(told.groupBy("comp").agg(F.count("*").alias("size"), F.sum(F.size("more") + F.size("less")).alias("shingles")).where("size > 1"))
    blocks = in_blocks(told.join(if_small(sizes), "comp"), "comp", "node", "size", EXACT_BLOCK, "shingles").select("comp", "i", "j", "block", "node", "class_docs", "n", "common", "more", "less")
    verified = durable(blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(threshold), "node bigint, links bigint, link_docs bigint, root bigint"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
    named = classes.select("node", "h1", "h2", "n", "class_id", "class_docs").join(per_class, "node", "left").join(groups, "node", "left")
    named = durable(named.select("h1", "h2", "n", "class_id", "class_docs", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("link_docs", F.lit(0)).alias("link_docs"), F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = durable(named.join(least, "root").drop("root"))
    own = signed.select("doc_id", "h1", "h2", "n").withColumn("counts", (F.col("n") > 0) & F.col("doc_id").isNotNull())
    found = own.where("counts").join(named, ["h1", "h2", "n"])
    return found.select("doc_id", "class_id", "class_docs", (F.col("class_docs") - 1 + F.col("link_docs")).alias("n_links"), F.col("links").alias("class_links"), "group_id").unionByName(
        own.where("not counts").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_docs"), F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("class_links"), F.col("doc_id").alias("group_id"))
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
