"""Language identification by a byte convolutional network.

One-hot bytes go through filters of several widths, the maximum over a fixed-length window is taken
of each, and a softmax layer follows; trained in numpy. A text's windows are all
classified in batches, and their log-probabilities averaged by window length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import durable, held_out, if_small, table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 12
#: About so many training windows for each language.
TRAIN_WINDOWS, WINDOWS_A_TEXT = 2000, 4
EPOCHS, BATCH, SEED = 4, 64, 11
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
SCHEMA = "doc_id bigint, lang_pred string, score double"


@dataclass
class Net:
    langs: list[str]
    filters: list[np.ndarray]  # for each width: width x 256 x FILTERS
    dense: np.ndarray
    bias: np.ndarray

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Rectified maxima of all filters over each row of bytes (WINDOW + the widest filter - 1)."""
        out = []
        for f in self.filters:
            y = f[0][windows[:, :WINDOW]]
            for j in range(1, len(f)):
                y += f[j][windows[:, j : WINDOW + j]]
            out.append(y.max(axis=1))
        return np.maximum(np.concatenate(out, 1), 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows of all lower-cased texts, each one's text and length; zero bytes fill the last."""
    raw, at = kernels.utf8(pc.utf8_lower(pc.fill_null(column, "")))
    count = -(-np.diff(at) // WINDOW)
    text = np.repeat(np.arange(len(at) - 1), count)
    start = at[:-1][text] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    index = start[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    stop = at[1:][text]
    windows = np.append(raw, np.uint8(0))[np.minimum(index, len(raw))]
    windows[index >= stop[:, None]] = 0
    return windows, text, np.minimum(stop - start, WINDOW)


def train(texts: list[str], langs: list[str]) -> Net | None:
    """Fit on short texts; None without any."""
    names = sorted(set(langs))
    if not names:
        return None
    place = {x: k for k, x in enumerate(names)}
    rng = np.random.Generator(np.random.PCG64(SEED))
    windows, text, length = windows_of(pa.array(texts, pa.string()))
    good = length >= min(24, int(length.max(initial=0)))
    windows, y = windows[good], np.array([place[x] for x in langs])[text[good]]
    net = Net(names, [(rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS], (rng.standard_normal((len(WIDTHS) * FILTERS, len(names))) * 0.2).astype(np.float32), np.zeros(len(names), np.float32))
    params = [*net.filters, net.dense, net.bias]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            _, grads = loss_and_gradients(net, windows[order[k : k + BATCH]], y[order[k : k + BATCH]])
            step += 1
            for x, g, m, s in zip(params, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x -= 0.01 * (0.5**epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def loss_and_gradients(net: Net, b: np.ndarray, t: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of windows ``b`` with classes ``t``, and its gradients by filters, dense and bias."""
    pooled, where = [], []
    for f in net.filters:
        z = f[0][b[:, :WINDOW]]
        for j in range(1, len(f)):
            z += f[j][b[:, j : WINDOW + j]]
        where.append(z.argmax(axis=1))
        pooled.append(np.take_along_axis(z, where[-1][:, None, :], 1)[:, 0])
    h = np.concatenate(pooled, 1)
    act = np.maximum(h, 0)
    z = act @ net.dense + net.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(np.maximum(p[np.arange(len(t)), t], 1e-30)).mean())
    p[np.arange(len(t)), t] -= 1
    p /= len(t)
    back = (p @ net.dense.T) * (h > 0)
    grads = []
    rows, n = np.arange(len(t))[:, None], net.filters[0].shape[2]
    for i, f in enumerate(net.filters):
        g, own, at = np.zeros_like(f), back[:, i * n : (i + 1) * n], where[i]
        for j in range(len(f)):
            np.add.at(g[j], (b[rows, at + j], np.arange(n)[None]), own)
        grads.append(g)
    return loss, [*grads, act.T @ p, p.sum(axis=0)]


def fit(docs: DataFrame, train_windows: int = TRAIN_WINDOWS) -> Net | None:
    """Learn from ``docs`` (doc_id, text, lang); rows without text, lang or doc_id don't count, equal rows count once.

    Every language that occurs is learned. The sample is bounded: of each about ``train_windows``
    windows, WINDOWS_A_TEXT a text, of the texts with the smallest hashes, at places
    that the hash chooses.
    """
    docs = docs.where("lang is not null and text is not null and doc_id is not null")
    texts = max(1, train_windows // WINDOWS_A_TEXT)
    shares = durable(docs.groupBy("lang").agg(F.least(F.lit(1.0), texts / F.count("*")).alias("share")))
    n_langs = shares.count()
    if not n_langs:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 40)) / (1 << 40)
    spots = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1, F.lit(WINDOW)) for k in range(WINDOWS_A_TEXT)]
    chosen = docs.withColumn("draw", draw).join(if_small(shares), "lang").where(F.col("draw") < F.col("share")).select("lang", "draw", F.array(*spots).alias("windows")).distinct()
    rows = chosen.orderBy("draw", "lang").limit(4 * texts * n_langs).collect()  # about a quarter of that comes
    rows.sort(key=lambda r: (r.lang, r.windows))
    pairs = [(w, r.lang) for r in rows for w in r.windows]
    return train([w for w, _ in pairs], [x for _, x in pairs])


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """Classify every whole text of ``docs`` (doc_id, text); returns the columns of ``SCHEMA``.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a net.
    Repeated rows are each classified; of equally likely languages the first by name wins; a very long text is classified
    by all its windows, some at a time; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by constants

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE_BYTES):
                n, column = part.num_rows, pc.fill_null(part.column(1), "")
                letter = np.asarray(pc.match_substring_regex(column, r"\pL"))
                langs, scores = [UNKNOWN] * n, np.zeros(n)
                if model is not None and letter.any():
                    windows, text, length = windows_of(column)
                    total = np.zeros((n, len(model.langs)))
                    for k in range(0, len(text), 512):
                        np.add.at(total, text[k : k + 512], model.log_probabilities(windows[k : k + 512]) * length[k : k + 512, None])
                    p = total / np.maximum(np.bincount(text, length, n), 1)[:, None]
                    p = np.exp(p - p.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    langs = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)]
                    scores = np.where(letter, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out("doc_id", 3, 1)))
    return predict(docs, net).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
