"""The array tokeniser against regular expressions."""

import numpy as np
import pyarrow as pa
from brute import benchmark_words, words
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelyard.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\n\t\x0b.é日-9", max_size=40)), max_size=8)


def spans(texts, separators, fold=False):
    data, offsets = W.column_bytes(pa.array(texts, pa.string()))
    data = W.LOWER[data] if fold else data
    starts, ends, rows = W.find_words(data, offsets, separators)
    out = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows):
        out[r].append(data[s:e].tobytes().decode())
    return out


@settings(deadline=None)
@given(TEXTS)
def test_words_equal_the_regular_expressions(texts):
    assert spans(texts, W.SPACES) == [words(t) for t in texts]
    assert spans(texts, W.NON_WORD, fold=True) == [benchmark_words(t) for t in texts]


def test_equal_words_have_equal_digests_and_others_differ():
    texts = ["a b a", "b", "x" * 5000 + " y " + "x" * 5000, "", None, "ab ba"]
    data, offsets = W.column_bytes(pa.array(texts))
    starts, ends, _ = W.find_words(data, offsets, W.SPACES)
    digests = W.digest_spans(data, starts, ends)
    own = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            assert (digests[i] == digests[j]) == (a == b)


def test_digests_do_not_depend_on_the_place():
    text = ("lorem ipsum " * 200_000).encode()  # over two blocks
    data, offsets = W.column_bytes(pa.array([text], pa.binary()))
    starts, ends, _ = W.find_words(data, offsets, W.SPACES)
    assert len(set(W.digest_spans(data, starts, ends).tolist())) == 2


def test_chunks_cover_all_rows_and_keep_long_rows_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 100, "c"])], names=["text"])
    parts = list(W.chunks(batch, "text", 12))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert list(W.chunks(batch.slice(0, 0), "text", 12)) == []


def test_covered_words():
    assert W.covered(np.array([1, 2]), 3, 8).tolist() == [False, True, True, True, True, False, False, False]
    assert W.covered(np.array([], np.int64), 3, 2).tolist() == [False, False]
