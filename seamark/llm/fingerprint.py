"""Document fingerprints by a randomised edit embedding.

All texts walk under the same randomness: at step j over character c the walk writes c and a
shared random bit of (j, c) says whether it goes on to the next character. Two texts at a small edit
distance fall into step again after an edit, so what they write has a small Hamming distance. A fingerprint
holds 4-bit samples of what was written at fixed random steps, equally many from each octave of
steps, so texts of any two lengths are compared at the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import durable, if_small, table

#: Samples of each octave of steps; the first octave has steps 0 to FIRST - 1, each later one doubles.
SAMPLES, FIRST = 32, 64
PERIOD = 1 << 14  # rows of random bits; a later step uses a row that its number hashes to
SLICE_BYTES = 12 << 20
#: Banding: keys a fingerprint, sampled places a key, places to take them from; from which likeness on pairs are near.
BANDS, BAND_SAMPLES, BAND_POOL, LEAST = 16, 6, 48, 0.8
BLOCK = 256  # classes of a band that meet in one join key
EDIT_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, found_edited boolean, found_next boolean"
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class _Walk:
    made: _Walk | None = None

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(77))
        self.bits = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
        self.bits[:, 0] = 0  # nothing comes after a text's end
        self.rng, self.steps = rng, [np.sort(rng.choice(FIRST, SAMPLES, replace=False))]

    def octave(self, k: int) -> np.ndarray:
        while len(self.steps) <= k:
            low = FIRST << (len(self.steps) - 1)
            self.steps.append(low + np.sort(self.rng.choice(low, SAMPLES, replace=False)))
        return self.steps[k]

    @classmethod
    def get(cls) -> _Walk:
        if cls.made is None:
            cls.made = cls()
        return cls.made


def fingerprints(texts: list[str]) -> list[str]:
    """Hex digits, SAMPLES for each octave that a text's walk reaches; empty for the empty text."""
    walk = _Walk.get()
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length + 1) - length - 1
    chars = np.zeros(int((length + 1).sum()), np.uint8)  # 0 ends a text
    for t, a, n in zip(texts, start.tolist(), length.tolist(), strict=True):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[a : a + n] = np.maximum((code * np.uint32(0x9E3779B1)) >> np.uint32(24), 1)
    nibble = ((np.arange(256, dtype=np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint8)
    shown = np.append(_HEX[nibble], np.uint8(0))
    shown[0] = ord(".")  # the walk has ended
    who = np.flatnonzero(length)
    at = start[who]
    rows: list[list[bytes]] = [[] for _ in texts]
    k, j = 0, 0
    while len(who):
        stop, sampled = FIRST << k, walk.octave(k).tolist()
        out, next_sample = np.full((len(who), SAMPLES), ord("."), np.uint8), 0
        live = np.arange(len(who))
        here = at
        while j < stop and len(live):
            until = min(stop, j + 64)
            for step in range(j, until):
                c = chars.take(here)
                if next_sample < SAMPLES and sampled[next_sample] == step:
                    out[live, next_sample] = shown.take(c)
                    next_sample += 1
                row = step if step < PERIOD else (step * 0x9E3779B1 >> 7) % PERIOD
                here = here + walk.bits[row].take(c)
            j = until
            going = chars.take(here) != 0
            if not going.all():
                live, here = live[going], here[going]
        j = stop
        for x, row in zip(who.tolist(), out, strict=True):
            rows[x].append(row.tobytes())
        who, at, k = who[live], here, k + 1
    return [b"".join(r).decode() for r in rows]


def likeness(a: str, b: str) -> float:
    """Share of the steps at which both walks wrote the same, as sampled; 1 for two empty texts."""
    n = max(len(a), len(b))
    if n == 0 or a == b:
        return 1.0
    x, y = (np.frombuffer(t.ljust(n, ".").encode(), np.uint8).reshape(-1, SAMPLES) for t in (a, b))
    end = ord(".")
    weight = np.maximum(1, 2.0 ** (np.arange(len(x)) - 1))
    some = ((x != end) | (y != end)).sum(axis=1) @ weight
    return float(((x == y) & (x != end)).sum(axis=1) @ weight / some) if some else 1.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text of ``docs``; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints([t or "" for t in part.column(1).to_pylist()]), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _spots(level: int) -> np.ndarray:
    """Sampled places of the first ``level`` octaves for each band, drawn as the octaves weigh in a likeness."""
    rng = np.random.Generator(np.random.PCG64([5, level]))
    weight = np.maximum(1, 2.0 ** (np.arange(level) - 1))
    octave = rng.choice(level, (BANDS, BAND_POOL), p=weight / weight.sum())
    return octave * SAMPLES + rng.integers(0, SAMPLES, octave.shape)


def band_keys(prints: list[str]) -> list[np.ndarray]:
    """Keys (int64) under which each fingerprint is filed; none for the empty one.

    A band's key is what stands at the first BAND_SAMPLES of its places where the walk hasn't ended, so two fingerprints
    of likeness s share a band with probability s ** BAND_SAMPLES, and one of all BANDS with 0.992 at s = LEAST. Where the last
    octave weighs so little that a fingerprint without it could be that near, keys without it are added.
    """
    raw = [np.frombuffer(p.encode(), np.uint8) for p in prints]
    wanted: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        level = len(x) // SAMPLES
        if level:
            wanted.setdefault(level, []).append(i)
        if level > 1:
            last = np.count_nonzero(x[-SAMPLES:] != ord("."))  # the octaves before weigh as much as the last one would in full
            if last <= (1 - LEAST) * (last + SAMPLES):
                wanted.setdefault(level - 1, []).append(i)
    keys: list[list[np.ndarray]] = [[] for _ in prints]
    for level, rows in wanted.items():
        spots = _spots(level)
        mark = ((np.arange(BANDS, dtype=np.int64) << 6 | min(level, 63)) << 3) << 4 * BAND_SAMPLES
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            x = np.stack([raw[i][: level * SAMPLES] for i in part])[:, spots]
            live = x != ord(".")
            nth = np.cumsum(live, axis=2, dtype=np.int64)
            live &= nth <= BAND_SAMPLES
            digit = np.where(x > 57, x - 87, x - 48).astype(np.int64)
            held = np.where(live, digit << 4 * (np.clip(nth, 1, BAND_SAMPLES) - 1), 0).sum(axis=2)
            own = mark + held + (live.sum(axis=2) << 4 * BAND_SAMPLES)
            for i, k, some in zip(part, own, live.any(axis=2), strict=True):
                keys[i].append(k[some])
    return [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]


def near_pairs(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of different fingerprints with a likeness of ``least`` (LEAST or more) or more, found by banding.

    ``prints`` has doc_id and fingerprint. Equal fingerprints are one class, named by its least
    doc_id. Pairs are between classes: class_a, class_b (class_a < class_b, or equal where one id has several
    fingerprints) and likeness. Rows with a null doc_id or an empty text don't count; an empty table gives no rows. Bands carry
    names only; one with over BLOCK classes is dealt out as pairs of blocks, so no task meets a whole group.
    """

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = band_keys(part.column(2).to_pylist())
                row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.concatenate(keys))], names=["class", "h", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [likeness(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], names=["class_a", "class_b", "likeness"])
            yield out.filter(pa.array([x >= least for x in like], pa.bool_()))

    classes = prints.where("doc_id is not null and fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    classes = durable(classes.select("class", F.xxhash64("fingerprint").alias("h"), "fingerprint"))
    bands = durable(classes.mapInArrow(filed, "class bigint, h bigint, band bigint"))
    sizes = durable(bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    side = lambda rows, x: rows.withColumn(x, F.struct("class", "h")).drop("class", "h", "n", "own")
    cold = bands.join(if_small(durable(sizes.where(F.col("n") <= BLOCK))), "band")
    few = side(cold, "a").join(side(cold, "b"), "band").where("a < b").select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK)
    hot = bands.join(if_small(durable(sizes.where(F.col("n") > BLOCK))), "band").withColumn("own", F.pmod(F.xxhash64("class", "h", "band"), blocks))
    left = side(hot.withColumns({"low": F.col("own"), "high": F.explode(F.sequence("own", blocks - 1))}), "a")
    right = side(hot.withColumns({"high": F.col("own"), "low": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own")))}), "b")
    many = left.join(right, ["band", "low", "high"]).where("a <> b and (low < high or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = few.unionByName(many).distinct()
    for x in ("a", "b"):
        own = classes.select(F.struct("class", "h").alias(x), F.col("fingerprint").alias(f"print_{x}"))
        pairs = pairs.join(own, x)
    return pairs.select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"), "print_a", "print_b").mapInArrow(verify, "class_a bigint, class_b bigint, likeness double")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, doc_id descending); the first of ``tail`` rows of a bucket only follows its last row."""
    held: tuple | None = None  # the row whose next text isn't known yet
    for batch in batches:
        for part in kernels.slices(batch, "text", SLICE_BYTES):
            ready, after = [], []
            for bucket, tail, doc, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                if held is not None and held[0] == bucket:
                    ready.append(held[1:])
                    after.append(text)
                    held = None
                if not tail:
                    held = (bucket, doc, text)
            if not ready:
                continue
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for (_, t), nxt in zip(ready, after, strict=True)]
            k = len(ready)
            # the next text of a row mostly is the row after it
            texts = [t for _, t in ready] + edited + [nxt if i + 1 == k or ready[i + 1][1] is not nxt else "" for i, nxt in enumerate(after)]
            prints = fingerprints(texts)
            nexts = [prints[i + 1] if i + 1 < k and ready[i + 1][1] is after[i] else prints[2 * k + i] for i in range(k)]
            keys = [set(x.tolist()) for x in band_keys(prints)]
            next_keys = [keys[i + 1] if i + 1 < k and ready[i + 1][1] is after[i] else keys[2 * k + i] for i in range(k)]
            near = [[likeness(a, b) for a, b in zip(prints[:k], others, strict=True)] for others in (prints[k : 2 * k], nexts)]
            met = [[a == b or not x.isdisjoint(y) for a, b, x, y in zip(prints[:k], others, keys[:k], theirs, strict=True)] for others, theirs in ((prints[k : 2 * k], keys[k : 2 * k]), (nexts, next_keys))]
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in ready], pa.int64()), pa.array([len(t) for _, t in ready], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), pa.array(prints[:k], pa.string()), pa.array(prints[k : 2 * k], pa.string()),
                *(pa.array(x, pa.float64()) for x in near),
                *(pa.array([m and x >= LEAST for m, x in zip(own, like, strict=True)], pa.bool_()) for own, like in zip(met, near, strict=True)),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "found_edited", "found_next"])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint every text of ``docs`` (doc_id, text), its edited text and the next document's.

    The next document is the one with the next smaller doc_id, after the last the first (a null id is
    the smallest; rows of one id follow each other by text). A text's edited form has its last
    floor(n/2) characters replaced by the next text's first as many, or all. Null texts are empty.
    found_edited and found_next say whether banding retrieves the other text and its likeness confirms it as near.
    Documents are dealt into ranges of ids, and the first of each range goes to the
    range before it too: no global order is made in one task. Rows of one id, however often it repeats, share a range. Repeated
    rows are each compared; a very long text is walked alone, in time in proportion to its length; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0]
    edges = sorted(set(cuts or []))  # at most one number for each partition
    bucket = _bucket(edges)
    firsts = docs.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("first")).orderBy("bucket").collect()  # one row a range
    if not firsts:
        return spark.createDataFrame([], EDIT_SCHEMA)
    # a range's last row is followed by the first of the range below, the lowest range's by the first of the highest
    target = F
    for i, r in enumerate(firsts):
        target = target.when(F.col("key") == r["first"], firsts[(i + 1) % len(firsts)].bucket)
    dealt = docs.withColumn("bucket", bucket.cast("int")).withColumn("target", target.cast("int"))
    copies = F.filter(F.array(F.struct("bucket", F.lit(0).alias("tail")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("tail"))), lambda x: x["bucket"].isNotNull())
    rows = dealt.select("key", "doc_id", "text", F.explode(copies).alias("x")).select("x.bucket", "x.tail", "key", "doc_id", "text")
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return rows.select("bucket", "tail", "doc_id", "text").mapInArrow(_edited, EDIT_SCHEMA)


def _bucket(edges: list[int]):
    """How many edges lie below the key, by a balanced tree of comparisons."""

    def build(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") <= edges[mid], build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(edges))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
