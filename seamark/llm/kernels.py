"""Vectorised text kernels that run on Arrow batches inside ``mapInArrow``.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes of the
lower-cased text; everything else separates. A *shingle* is five consecutive words; a text of one to
four words has one shingle, made of all its words; a text without words has none.
Null texts count as empty. Hashes are 64-bit and the same in every batch and process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Text bytes that one kernel call handles; only a single longer text exceeds it.
SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes together."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    part = (np.cumsum(np.asarray(size, dtype=np.int64) + 16) - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and where each text begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the first word of each text (n + 1 values)."""
    raw, at = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _WORD[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_UNBASE, n)[starts])
    return hashes, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and the first shingle of each text (n + 1 values)."""
    count = np.diff(first)
    full = np.maximum(count - SHINGLE + 1, 0)
    made = np.where(count == 0, 0, np.maximum(full, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], np.uint64)
    if len(out) == 0:
        return out, begin
    with np.errstate(over="ignore"):
        if len(hashes) >= SHINGLE:
            rolled = hashes[: len(hashes) - SHINGLE + 1] * _STEP[0]
            for j in range(1, SHINGLE):
                rolled = rolled + hashes[j : len(hashes) - SHINGLE + 1 + j] * _STEP[j]
            where = np.arange(begin[-1]) - np.repeat(begin[:-1], made) + np.repeat(first[:-1], made)
            whole = np.repeat(full > 0, made)
            out[whole] = rolled[where[whole]]
        for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
            out[begin[d]] = (hashes[first[d] : first[d + 1]] * _STEP[: count[d]]).sum(dtype=np.uint64) + np.uint64(count[d])
    return mix(out), begin


def of_text(text: str) -> np.ndarray:
    """Shingle hashes of one text, in order."""
    return shingles(*words(pa.array([text], pa.string())))[0]


class Lookup:
    """Exact membership of 64-bit values in a fixed set; a bitmap answers most of them."""

    def __init__(self, values: np.ndarray, bits: int = 20) -> None:
        self.values = np.unique(np.asarray(values, np.uint64))
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``x`` whose value is in the set, and their places in ``values``."""
        maybe = np.flatnonzero(self.seen[(x & self.mask).astype(np.int64)])
        if len(maybe) == 0 or len(self.values) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
        hit = self.values[place] == x[maybe]
        return maybe[hit], place[hit]
