"""Sampled segmentations against the distribution over all of them, and in any chunk."""

import math
from collections import Counter

import numpy as np
import pytest

from scorenet.llm import piece_sampling as ps

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pieces():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return ps.Pieces(f.read())


def all_paths(pieces, text):
    """Each segmentation of one unit into pieces that the vocabulary has, with its weight."""
    known = {pieces.text[i].decode(): i for x in pieces.found.values() for i in x.values.tolist()}
    out = {}

    def walk(rest, ids, log):
        if not rest:
            out[tuple(ids)] = math.exp(log)
        for n in range(1, len(rest) + 1):
            i = known.get(rest[:n])
            if i is not None:
                walk(rest[n:], [*ids, i], log + pieces.log[i])

    walk(" " + text, [], 0.0)
    return out


@pytest.mark.parametrize("text", ["the", "hello", "abab"])
def test_distribution(pieces, text):
    want = all_paths(pieces, text)
    total, n = sum(want.values()), 40_000
    got = Counter(tuple(x.tolist()) for x in ps.sample_ids([text] * n, list(range(n)), pieces))
    assert got.keys() <= want.keys() and len(want) > 3
    for path, w in want.items():
        p = w / total
        assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_chunks_and_order_change_nothing(pieces):
    texts = ["one two three", "größer  als\nnichts", "", None, "tok\u2581en 😀 x", "one two three four " * 40, "  lead"]
    keys = [5, 6, 7, 8, None, 10, 11]
    whole = ps.sample_ids(texts, keys, pieces)
    alone = [ps.sample_ids([t], [k], pieces)[0] for t, k in zip(texts, keys)]
    back = ps.sample_ids(texts[::-1], keys[::-1], pieces)[::-1]
    for a, b, c, t in zip(whole, alone, back, texts):
        assert np.array_equal(a, b) and np.array_equal(a, c)
        assert not t or pieces.decode(a) == t
    assert not np.array_equal(whole[5], ps.sample_ids([texts[5]], [12], pieces)[0])


def test_very_long_word(pieces):
    text = "ab" * 60_000
    assert pieces.decode(ps.sample_ids([text], [1], pieces)[0]) == text
