"""Embedding back-ends: text in, ``array<float>`` out, in Arrow batches on the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import stub_vector

Embed = Callable[[list[str]], np.ndarray]
BUCKETS = (64, 128, 256, 512)


def embedded(rows: DataFrame, text: str, name: str, make: Callable[[], Embed], batch: int, prefix: str | None = None) -> DataFrame:
    """``rows`` with the vector of a text column; ``make`` loads the model, once a task.

    Texts of a batch are ordered by length, so that padding is short, and put back in place.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            model = model or make()
            texts = [(prefix or "") + (t or "") for t in pdf[text]]
            order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
            vectors: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                for i, v in zip(some, model([texts[i] for i in some]), strict=True):
                    vectors[i] = np.asarray(v, np.float32)
            pdf[name] = vectors
            yield pdf

    return rows.mapInPandas(run, schema)


def with_stub(rows: DataFrame, text: str, name: str, dims: int = 64) -> DataFrame:
    """Deterministic vectors without a model, for tests; they stay in the JVM."""
    return rows.withColumn(name, stub_vector(F.coalesce(F.col(text), F.lit("")), dims).cast("array<float>"))


@dataclass
class StaticModel:
    """A table of token vectors: a text's vector is the mean of its tokens', zero without any."""

    encode: Callable[[list[str]], list[list[int]]]
    matrix: np.ndarray
    normalize: bool = True

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.matrix.shape[1]), np.float32)
        for i, ids in enumerate(self.encode(texts)):
            ids = [t for t in ids if t < len(self.matrix)]
            if ids:
                v = self.matrix[ids].mean(axis=0, dtype=np.float64)
                n = np.linalg.norm(v)
                out[i] = v / n if self.normalize and n > 0 else v
        return out


def seq_buckets(max_length: int) -> list[int]:
    """Lengths that token rows are padded to."""
    return sorted({*(b for b in BUCKETS if b < max_length), max_length})


def padded(rows: list[list[int]], pad: int, buckets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one fixed shape; longer rows are cut at the largest bucket."""
    width = next((b for b in buckets if b >= max((len(r) for r in rows), default=1)), buckets[-1])
    ids, mask = np.full((len(rows), width), pad, np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        r = r[:width]
        ids[i, : len(r)], mask[i, : len(r)] = r, 1
    return ids, mask


def pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Pool (rows, tokens, width) states and normalise; as the column expression does."""
    if how == "cls":
        v = states[:, 0]
    elif how == "last":
        last = np.where(mask.any(axis=1), mask.shape[1] - 1 - mask[:, ::-1].argmax(axis=1), 0)
        v = states[np.arange(len(states)), last]
    else:
        v = (states * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v.astype(np.float64), where=n > 0)


class OnnxEncoder:
    """An encoder run by onnxruntime; prefers an output of one vector a text, else pools token states."""

    def __init__(self, weights: str, tokenizer: str, pooling: str = "mean", max_length: int = 448) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(weights, providers=["CPUExecutionProvider"])
        self.tokenizer, self.pooling, self.buckets = Tokenizer.from_file(tokenizer), pooling, seq_buckets(max_length)
        self.tokenizer.enable_truncation(max_length)

    def __call__(self, texts: list[str]) -> np.ndarray:
        ids, mask = padded([e.ids for e in self.tokenizer.encode_batch(texts)], 0, self.buckets)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        found = self.session.run(None, {i.name: feeds[i.name] for i in self.session.get_inputs()})
        flat = next((x for x in found if x.ndim == 2), None)
        if flat is not None:
            n = np.linalg.norm(flat, axis=1, keepdims=True)
            return np.divide(flat, n, out=flat.astype(np.float64), where=n > 0)
        return pool(found[0], mask, self.pooling)


class RemoteEncoder:
    """A service that answers POST /embeddings with {"data": [{"index", "embedding"}]}.

    What a busy or failing service (429, 5xx, no connection) refuses is asked again, RETRIES times, after longer and longer
    waits; with ``dimensions`` vectors of another width are an error.
    """

    RETRIES, WAIT = 4, 0.5

    def __init__(self, url: str, model: str, key: str = "", batch: int = 32, concurrency: int = 4, dimensions: int | None = None) -> None:
        self.url, self.model, self.key, self.batch, self.concurrency, self.dimensions = url.rstrip("/"), model, key, batch, concurrency, dimensions

    @staticmethod
    def parsed(answer: dict, expected: int) -> list[list[float]]:
        """Vectors in the order of what was asked."""
        rows = sorted(answer["data"], key=lambda r: r.get("index", 0))
        if len(rows) != expected:
            raise ValueError(f"{expected} texts were sent and {len(rows)} vectors came back")
        return [r["embedding"] for r in rows]

    def _ask(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), head)
        for turn in range(self.RETRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=120) as f:
                    found = self.parsed(json.load(f), len(texts))
                break
            except urllib.error.URLError as e:
                if turn == self.RETRIES or (isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500):
                    raise
                time.sleep(self.WAIT * 2**turn)
        if self.dimensions and any(len(v) != self.dimensions for v in found):
            raise ValueError(f"{self.model} gives vectors of another width than {self.dimensions}")
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [texts[k : k + self.batch] for k in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(self.concurrency) as pool_:
            return np.array([v for part in pool_.map(self._ask, parts) for v in part], np.float32)
