import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm import token_counts as K


def greedy(word, initial, inside):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1, True
        n, at = n + 1, end
    return n, False


def words_of(text):
    return re.findall(rb"(?: ?[^ \t\n\v\f\r]+)|(?:[ \t\n\v\f\r]+(?=$|(?<! )[^ \t\n\v\f\r])|[ \t\n\v\f\r]+(?= [^ \t\n\v\f\r]))", text)


PIECES = st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=14)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, st.lists(st.text(alphabet="abc", min_size=1, max_size=14), min_size=1, max_size=6))
def test_automaton_against_greedy(initial, inside, words):
    import numpy as np

    raw = "".join(words).encode()
    stop = np.cumsum([len(w) for w in words])
    start = stop - [len(w) for w in words]
    for a, own in ((K.Automaton.build(list(initial), list(inside)), inside), (K.Automaton.build(list(initial)), initial)):
        n, unknown = a.count(np.frombuffer(raw, np.uint8), start, stop)
        assert list(zip(n.tolist(), unknown.tolist(), strict=True)) == [greedy(w.encode(), initial, own) for w in words]


def test_real_vocabulary():
    pieces = K.read_ranks()
    automaton, known = K.Automaton.build(pieces), set(pieces)
    texts = ["The quick  brown\n\n fox's naïveté 😀!", " lead", "", None, "tail  ", "x" * 3000, "a\tb c"]
    got = K.word_counts(pa.array(texts), automaton)
    for t, n, w, u in zip(texts, *(x.tolist() for x in got), strict=True):
        raw, begin, _ = K.cut(pa.array([t]))
        words = [raw[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]
        assert b"".join(words) == (t or "").encode() and w == len(words) and u == 0
        assert n == sum(greedy(x, known, known)[0] for x in words)


def test_cut():
    raw, begin, first = K.cut(pa.array(["a  b\n c", None, " x", "  "]))
    words = [raw[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)]
    assert words == [b"a", b" ", b" b", b"\n", b" c", b" x", b"  "] and first.tolist() == [0, 5, 5, 6, 7]


def test_odd_rows(spark, odd, nothing):
    a = K.Automaton.build(K.read_ranks())
    got = K.count_tokens(odd, a).collect()
    assert len(got) == 12 and all((r.n_tokens == 0) == (r.n_words == 0) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert K.count_tokens(nothing, a).count() == 0 and K.count_tokens(odd, K.Automaton.build([])).where("n_unknown < n_words").count() == 0


def test_long_words_go_byte_by_byte():
    import time

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(6))
    pieces = [bytes(x) for x in {tuple(rng.integers(97, 100, rng.integers(1, 5)).tolist()) for _ in range(30)}]
    a = K.Automaton.build([*pieces, b"a", b"b", b"c"])
    words = [bytes(rng.integers(97, 100, n).tolist()) for n in (K.LONG - 1, K.LONG, K.LONG + 1, 1000, 3)] + [b"ab" * 200 + b"?" + b"c" * 5]
    stop = np.cumsum([len(w) for w in words])
    n, unknown = a.count(np.frombuffer(b"".join(words), np.uint8), stop - [len(w) for w in words], stop)
    assert list(zip(n.tolist(), unknown.tolist(), strict=True)) == [greedy(w, set(pieces) | {b"a", b"b", b"c"}, set(pieces) | {b"a", b"b", b"c"}) for w in words]
    began = time.time()
    a.count(np.frombuffer(b"abc" * 333_333, np.uint8), np.array([0]), np.array([999_999]))
    assert time.time() - began < 5
