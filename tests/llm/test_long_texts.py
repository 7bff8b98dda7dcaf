"""Long texts give the words and shingles of short ones, in portions of bounded size."""

import random

import numpy as np
import pytest

from boreflow.llm import minmax_dedup as m


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_words_in_portions(size):
    rng = random.Random(size)
    text = b"".join(rng.choice([b"a", b"Bc", b"\x00", b" ", b"\n", b"\x0b", b"  ", "é".encode(), b"long" * 5]) for _ in range(900))
    texts = [text, b"", b" ", text[:50], b"x" * 3000, b"\t" * 500, text[::-1]]
    want, counts = m.word_hashes(texts)
    got, n = m.all_word_hashes(texts, size)
    assert np.array_equal(want, got) and counts.tolist() == n.tolist()
    assert sum(len(t) for t in texts) > 2 * size  # the portions were taken
    for t in texts:
        pieces = list(m.portions(t, size))
        assert [w for p in pieces for w in p.split()] == t.split()
        assert sum(len(p) + 1 for p in pieces) == len(t) + 1


def test_shingles_of_a_long_text(monkeypatch):
    words = [f"w{i % 5000}" for i in range(20_000)]
    text = " ".join(words).encode()
    want = m.shingle_sets([text])[0]
    monkeypatch.setattr(m.all_word_hashes, "__defaults__", (1000,))
    before = m._Powers.up, m._Powers.down
    m._Powers.up, m._Powers.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
    try:
        assert np.array_equal(m.shingle_sets([text])[0], want)
    finally:
        m._Powers.up, m._Powers.down = before
    assert len(want) == 5000
