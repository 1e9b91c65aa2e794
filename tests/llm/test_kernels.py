"""Kernels on arbitrary texts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from taskplane.llm import kernels, neardup, training_order, weak_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab \n\t#\x0b", max_size=200)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = kernels.flatten(pa.array(texts, pa.string()))
    s, e = kernels.spans(~kernels.SPACE[data], offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == [w for t in texts for w in WORD.findall(t or "")]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_measures(texts):
    got = weak_rules.count_batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert (got["n_words"][i], got["word_chars"][i], got["n_dup_lines"][i], got["n_repeat_words"][i], got["n_distinct"][i], got["n_lines"][i]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(inside), len(set(words)), len(lines))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(texts, n):
    got = [s for _, run in neardup.shingle_sets(pa.array(texts, pa.string()), n) for s in run]
    want = []
    for t in texts:
        w = (t or "").encode().lower().split()
        want.append(frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    assert [s.size for s in got] == [len(s) for s in want]
    for a, x in zip(got, want):
        for b, y in zip(got, want):
            assert np.intersect1d(a, b).size == len(x & y)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(-(2**70), 2**70))
def test_feistel(n, key):
    y = training_order.feistel(np.arange(n), n, key)
    assert sorted(y.tolist()) == list(range(n))
    assert (training_order.feistel(y, n, key, inverse=True) == np.arange(n)).all()


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_byte_stream(texts):
    stream, starts = training_order.byte_stream(pa.array(texts, pa.string()))
    assert stream.tobytes() == b"".join((t or "").encode() + b"\xff" for t in texts)
    assert [stream[s:].tobytes().split(b"\xff")[0].decode() for s in starts] == [t or "" for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=30), st.integers(1, 4000))
def test_pieces(sizes, most):
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    got = list(kernels.pieces(offsets, most))
    assert [k for i, j in got for k in range(i, j)] == list(range(len(sizes)))
    assert all(offsets[j] - offsets[i] <= most or j == i + 1 for i, j in got)
