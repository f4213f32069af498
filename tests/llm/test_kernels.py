import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm import kernels

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abCD é-\n_9", max_size=30)), max_size=8))
def test_words_and_shingles(texts):
    column = pa.array(texts, pa.string())
    hashes, first = kernels.words(column)
    shingle, begin = kernels.shingles(hashes, first)
    same = {}
    for d, t in enumerate(texts):
        own = words(t)
        assert first[d + 1] - first[d] == len(own)
        for w, h in zip(own, hashes[first[d] : first[d + 1]].tolist(), strict=True):
            assert same.setdefault(w, h) == h
        want = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
        got = shingle[begin[d] : begin[d + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_slices_keep_all_rows():
    batch = pa.record_batch({"id": range(9), "text": ["x" * 50] * 4 + [None, "y" * 500, "", "z", "z"]})
    parts = list(kernels.slices(batch, "text", 100))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(9)) and len(parts) > 3
    together = kernels.words(batch.column(1))[0]
    assert (np.concatenate([kernels.words(p.column(1))[0] for p in parts]) == together).all()


def test_lookup():
    values = np.array([5, 2**63, 7], np.uint64)
    at, place = kernels.Lookup(values, 3).find(np.array([7, 15, 2**63, 6], np.uint64))
    look = kernels.Lookup(values, 3)
    assert at.tolist() == [0, 2] and look.values[place].tolist() == [7, 2**63]
    assert len(kernels.Lookup(np.zeros(0, np.uint64)).find(values)[0]) == 0
