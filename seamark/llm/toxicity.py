"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean documents, smoothed by a Dirichlet prior in proportion to
the words' frequency in both; only words whose log-odds stand out from their standard error score.
A linear scan finds all maximal scoring segments of a text. Under the extreme-value law of such
segments in clean text, the best segment's score becomes a p-value for a text of its length,
and a logistic curve fitted on documents apart from the words' makes a probability of that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import durable, held_out, table

#: At most so many labelled documents are learned from (those with the smallest hash of the id), one text each.
TRAIN_DOCS = 20_000
#: Least z and least log-odds (either sign) of a scoring word; what each word costs a segment at least.
MIN_Z, MIN_ODDS, DRIFT = 3.0, 1.0, 0.1
PRIOR, SIGNIFICANT = 0.1, 0.05
SEGMENT = "struct<start:bigint,stop:bigint,score:double>"
SCHEMA = f"doc_id bigint, score double, predicted int, p_value double, segments array<{SEGMENT}>"


@dataclass
class Model:
    words: kernels.Lookup
    weights: np.ndarray
    rate: float  # lambda of the extreme-value law
    size: float  # its K
    drift: float  # what each word costs a segment, so that clean text's expected score is negative
    bias: float
    slope: float

    def p_value(self, score: float, n: int) -> float:
        if score <= 0:
            return 1.0
        return -math.expm1(-self.size * max(n, 1) * math.exp(-self.rate * score))

    def probability(self, p: float) -> float:
        x = self.bias + self.slope * math.log1p(-math.log(max(p, 1e-300)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score), in linear time.

    ``scores`` are those of the words at ``places``; each word between them has -drift.
    """
    left: list[float] = []
    right: list[float] = []
    before: list[int] = []  # the nearest earlier candidate that starts lower
    spans: list[tuple[int, int]] = []
    total, last = 0.0, -1
    for at, score in zip(places, scores, strict=True):
        total -= drift * (at - last - 1)
        last = at
        low, total, start = total, total + score, at
        if score <= 0:
            continue
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = before[j]
            if j < 0 or right[j] >= total:
                break
            low, start, lower = left[j], spans[j][0], before[j]
            del left[j:], right[j:], before[j:], spans[j:]
            j = lower
        left.append(low)
        right.append(total)
        before.append(j)
        spans.append((start, at + 1))
    return [(a, b, r - lo) for (a, b), lo, r in zip(spans, left, right, strict=True)]


def scan(column: pa.Array, words: kernels.Lookup, weights: np.ndarray, drift: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its number of words and its maximal segments."""
    hashes, first = kernels.words(column)
    at, place = words.find(hashes)
    cut = np.searchsorted(at, first)
    scores = (weights[place] - drift).tolist()
    where = at.tolist()
    for d in range(len(first) - 1):
        a, b, base = int(cut[d]), int(cut[d + 1]), int(first[d])
        yield int(first[d + 1]) - base, maximal_segments([x - base for x in where[a:b]], scores[a:b], drift) if b > a else []


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            hashes, first = kernels.words(part.column(0))
            toxic = np.asarray(part.column(1)).astype(bool)
            for kind in (False, True):
                own = [np.unique(hashes[first[d] : first[d + 1]]) for d in np.flatnonzero(toxic == kind)]
                if own:
                    word, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n * kind, pa.int64()), pa.array(n * (not kind), pa.int64())], names=["word", "toxic", "clean"])


def _scores(words: kernels.Lookup, weights: np.ndarray, drift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                found = list(scan(part.column(0), words, weights, drift))
                best = [max((s for _, _, s in segments), default=0.0) for _, segments in found]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64())], names=["toxic", "n", "best"])

    return run


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic 0 or 1), a bounded sample as ``training_rows`` draws it.

    Seven of ten go to the words, the rest to the calibration. With one class only, nothing scores. The words that score
    come to the driver: those of the sample that stand out, in at least some ten of its documents each.
    """
    chosen = labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)))
    for_words = chosen.where("part < 7").select("text", "toxic")
    counts = for_words.mapInArrow(_word_counts, "word bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = durable(counts)
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = float(sums[0] or 0), float(sums[1] or 0)
    none = Model(kernels.Lookup(np.zeros(0, np.uint64)), np.zeros(0), 1.0, 1.0, DRIFT, -3.0, 0.0)
    if not n_toxic or not n_clean:
        return none
    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    odds = lambda y, n: F.log((y + prior) / (n * (1 + PRIOR) - y - prior))
    delta = odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    rows = counts.select("word", "clean", delta.alias("delta"), z.alias("z")).where((F.abs("z") >= MIN_Z) & (F.abs("delta") >= MIN_ODDS)).collect()
    if not any(r.delta > DRIFT for r in rows):
        return none
    rows.sort(key=lambda r: r.word & (2**64 - 1))
    words, weights = kernels.Lookup(np.array([r.word for r in rows], np.int64).view(np.uint64)), np.array([r.delta for r in rows])
    share = (np.array([r.clean for r in rows]) + 0.5) / (n_clean + 1)
    drift = max(DRIFT, 2 * float((share * weights).sum()))
    rest, steps = max(1e-9, 1 - share.sum()), weights - drift
    low, high = 1e-6, 20.0
    while high - low > 1e-9:  # the positive root of sum p exp(rate * score) = 1
        mid = (low + high) / 2
        low, high = (low, mid) if rest * math.exp(-mid * drift) + (share * np.exp(np.minimum(mid * steps, 600))).sum() > 1 else (mid, high)
    rate = low
    rows = chosen.where("part >= 7").select("text", "toxic").mapInArrow(_scores(words, weights, drift), "toxic int, n bigint, best double").collect()  # a part of the sample, three numbers a document
    clean = [r for r in rows if not r.toxic]
    size = len(clean) / max(1e-9, sum(max(r.n, 1) * math.exp(-rate * r.best) for r in clean)) if clean else 1.0
    model = Model(words, weights, rate, size, drift, 0.0, 0.0)
    x = np.array([math.log1p(-math.log(max(model.p_value(r.best, r.n), 1e-300))) for r in rows])
    y = np.array([r.toxic for r in rows], float)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.diag([1e-3, 0.05])
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(w[0]), max(0.0, float(w[1]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text); returns the columns of ``SCHEMA``.

    ``segments`` are the segments with an expected number of chance finds of at most
    ``SIGNIFICANT``, by words (start, stop). Null and empty texts score as texts without any finding.
    Repeated rows are each scored; of equally good segments the first counts; a very long text is scanned alone, in time
    in proportion to its length; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                ps, segments = [], []
                for n, found in scan(part.column(1), m.words, m.weights, m.drift):
                    ps.append(m.p_value(max((s for _, _, s in found), default=0.0), n))
                    segments.append([{"start": a, "stop": b, "score": s} for a, b, s in found if m.size * max(n, 1) * math.exp(-m.rate * s) <= SIGNIFICANT])
                scores = [m.probability(p) for p in ps]
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(ps), pa.array(segments, kinds)], names=["doc_id", "score", "predicted", "p_value", "segments"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Labelled documents outside the held-out fifth, at most ``train_docs``, written once.

    Of several labels of an id the largest counts; of several documents of an id the one whose text has the least hash.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # train_docs bounds it
    return durable(rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", F.size("segments").cast("bigint").alias("n_segments"))
