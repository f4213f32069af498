"""Token counts by a linear longest-match automaton.

Greedy word-piece lengths come from a trie of the vocabulary with failure links: when no transition
fits, the link leads to the state of what remains after the longest pieces are popped, and their
number is precomputed, so no byte is read twice and no piece is built. All distinct words of a
batch step through the automaton together; words of over LONG bytes, of which there are few, go one by one.

A word is a run of bytes other than white space with one directly preceding space, if any; each
other run of white space is a word of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id bigint, n_tokens bigint, n_words bigint, n_unknown bigint"
SLICE_BYTES = 4 << 20
LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a file, on the driver, of base64 pieces and ranks; a FileNotFoundError if there is none."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """States 0 (start of a word) and 1 (inside a word) are roots; -1 is none."""

    keys: np.ndarray  # state * 256 + byte, sorted
    to: np.ndarray
    link: np.ndarray
    popped: np.ndarray

    @staticmethod
    def build(initial: list[bytes], inside: list[bytes] | None = None) -> Automaton:
        """``initial`` pieces begin a word, ``inside`` pieces go on; without the latter one set does both."""
        go: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        order: list[tuple[int, int, int]] = []
        one = inside is None
        for root, pieces in ((1, initial),) if one else ((0, initial), (1, inside)):
            for piece in pieces:
                s = root
                for c in piece:
                    t = go[s].get(c)
                    if t is None:
                        t = go[s][c] = len(go)
                        go.append({})
                        final.append(False)
                        order.append((s, c, t))
                    s = t
                final[s] = final[s] or s > 1
        if one:
            go[0] = go[1]
        depth = [0] * len(go)
        for s, _, t in order:
            depth[t] = depth[s] + 1
        link, popped = [-1] * len(go), [0] * len(go)
        for s, c, t in sorted(order, key=lambda x: depth[x[2]]):
            if final[t]:
                link[t], popped[t] = 1, 1
                continue
            z, n = link[s], popped[s]
            while z >= 0 and c not in go[z]:
                n, z = n + popped[z], link[z]
            if z >= 0:
                link[t], popped[t] = go[z][c], n
        keys = np.array([s * 256 + c for s in range(len(go)) for c in go[s]], np.int64)
        to = np.array([t for s in range(len(go)) for t in go[s].values()], np.int32)
        at = np.argsort(keys)
        return Automaton(keys[at], to[at], np.array(link, np.int32), np.array(popped, np.int32))

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(state), -1, np.int32)
        key = state.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], np.int32(-1))

    def count_one(self, word: bytes) -> tuple[int, bool]:
        """Pieces of one word, byte by byte."""
        if self.__dict__.get("_step") is None:
            self._step = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.link.tolist(), self.popped.tolist()
        step, link, popped = self._step
        n, state = 0, 0
        for byte in word:
            while (to := step.get(state * 256 + byte)) is None:
                if link[state] < 0:
                    return 1, True
                n += popped[state]
                state = link[state]
            state = to
        while state > 1:
            if link[state] < 0:
                return 1, True
            n += popped[state]
            state = link[state]
        return n, False

    def count(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word raw[start:stop]; a word that can't be cut counts 1 and is unknown."""
        long = stop - start > LONG
        if long.any():
            n, unknown = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
            n[~long], unknown[~long] = self.count(raw, start[~long], stop[~long])
            for k in np.flatnonzero(long).tolist():
                n[k], unknown[k] = self.count_one(raw[start[k] : stop[k]].tobytes())
            return n, unknown
        n = np.zeros(len(start), np.int64)
        unknown = np.zeros(len(start), bool)
        state = np.zeros(len(start), np.int32)
        live = np.argsort(start - stop, kind="stable")  # longest first
        length = (stop - start)[live]
        for j in range(int(length[0]) if len(length) else 0):
            live = live[: int(np.searchsorted(-length, -j, side="left"))]
            length = length[: len(live)]
            go = live[~unknown[live]]
            while len(go):
                byte = raw[start[go] + j]
                t = self._next(state[go], byte)
                ok = t >= 0
                state[go[ok]] = t[ok]
                go = go[~ok]
                dead = self.link[state[go]] < 0
                unknown[go[dead]] = True
                go = go[~dead]
                n[go] += self.popped[state[go]]
                state[go] = self.link[state[go]]
        go = np.flatnonzero(~unknown & (state > 1))
        while len(go):
            dead = self.link[state[go]] < 0
            unknown[go[dead]] = True
            go = go[~dead]
            n[go] += self.popped[state[go]]
            state[go] = self.link[state[go]]
            go = go[state[go] > 1]
        n[unknown] = 1
        return n, unknown


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where each word begins (and the end), and the first word of each text."""
    raw, at = kernels.utf8(column)
    n = len(raw)
    if n == 0:
        return raw, np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    opens = np.zeros(n, bool)
    opens[at[:-1][at[:-1] < n]] = True  # texts begin
    run = ~space
    run[1:] &= space[:-1] | opens[1:]
    heads = np.flatnonzero(run)
    took = heads[(heads > 0) & ~opens[heads]]
    took = took[raw[took - 1] == 32] - 1  # the spaces that words take along
    taken = np.zeros(n, bool)
    taken[took] = True
    begins = run.copy()
    begins[took + 1] = False
    begins[took] = True
    loose = space & ~taken
    first_loose = loose.copy()
    first_loose[1:] &= ~loose[:-1] | opens[1:]
    begins |= first_loose
    starts = np.flatnonzero(begins)
    return raw, np.append(starts, n), np.searchsorted(starts, at)


def word_counts(column: pa.Array, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, words and unknown words of each text; each distinct word is counted once."""
    raw, begin, first = cut(column)
    starts, stops = begin[:-1], begin[1:]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(kernels._BYTE[raw] * kernels._power(kernels._BASE, len(raw)), out=total[1:])
    hashes = kernels.mix((total[stops] - total[starts]) * kernels._power(kernels._UNBASE, max(1, len(raw)))[starts])
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    n, unknown = automaton.count(raw, starts[one], stops[one])
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which])])[first])
    return sums(n), np.diff(first), sums(unknown.astype(np.int64))


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text); returns the columns of ``SCHEMA``.

    Null and empty texts have none. Repeated rows are each counted; a very long text or word takes time and memory in
    proportion to its length; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for part in kernels.slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in word_counts(part.column(1), a))], names=["doc_id", "n_tokens", "n_words", "n_unknown"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Automaton.build(read_ranks(vocabulary)))
