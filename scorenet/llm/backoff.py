"""Character contexts of texts, and lookups in tables of n-gram probabilities with back-off.

A text is its characters and an end mark. The context of length k of a place is a hash of the k characters
before it; a start mark stands before a text, and nothing before that. A context's parent drops the
farthest character.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_key(context: np.ndarray, ch: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(31) + ch.astype(np.uint64) + np.uint64(7))


def preceding(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each text, character of each place, what stands 1 to ``longest`` places before it) of
    texts in UTF-8 that hold no line feed, which is the end mark. A character counts as its code and 1, the
    start mark as 1, nothing as 0."""
    text = (b"\n".join(texts) + b"\n").decode("utf-8", "surrogatepass")
    ch = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(ch == 10)
    first = np.r_[0, ends[:-1] + 1]
    inside = np.arange(len(ch)) - np.repeat(first, ends - first + 1)
    before = np.zeros((longest, len(ch)), np.uint32)
    for k in range(1, longest + 1):
        before[k - 1, k:] = ch[:-k] + np.uint32(1)
        before[k - 1, inside == k - 1] = 1  # the start mark
        before[k - 1, inside < k - 1] = 0
    return first, ch, before


def hashed(before: np.ndarray) -> np.ndarray:
    """Contexts, rows 0 to the number of rows given, of what stands before places; the empty context is 0."""
    contexts = np.zeros((len(before) + 1, before.shape[1]), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k, row in enumerate(before, 1):
            power = power * _BASE
            contexts[k] = contexts[k - 1] + row.astype(np.uint64) * power
    return contexts


def spell(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each text, character of each place, contexts by length and place) of such texts."""
    first, ch, before = preceding(texts, longest)
    return first, ch, hashed(before)


class KeyTable:
    """Rows by 64-bit key, found without searching: the top bits of a key give a short run."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.at = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.deepest = int(np.diff(self.at).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        top = (keys >> self.shift).astype(np.int64)
        pos, end = self.at[top], self.at[top + 1]
        out = np.full(len(keys), -1)
        live = np.flatnonzero(pos < end)
        for _ in range(self.deepest):
            if not len(live):
                break
            p = pos[live]
            hit = self.keys[p] == keys[live]
            out[live[hit]] = p[hit]
            live = live[~hit]
            pos[live] += 1
            live = live[pos[live] < end[live]]
        return out


class BackoffTable:
    """Interpolated probabilities of seen n-grams for each context length, and each context's weight
    for its parent."""

    def __init__(self, grams: list[KeyTable], weights: list[KeyTable], uniform: float):
        self.grams, self.weights, self.uniform = grams, weights, uniform

    def text_logs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log of each text's probability, characters with the end mark)."""
        longest = len(self.grams) - 1
        first, ch, contexts = spell(texts, longest)
        p = np.ones(len(ch))
        todo = np.arange(len(ch))
        for k in range(longest, -1, -1):
            at = self.grams[k].find(gram_key(contexts[k, todo], ch[todo]))
            hit = at >= 0
            p[todo[hit]] *= self.grams[k].values[at[hit]]
            todo = todo[~hit]
            at = self.weights[k].find(mixed(contexts[k, todo]))
            seen = at >= 0
            p[todo[seen]] *= self.weights[k].values[at[seen]]
        p[todo] *= self.uniform
        logs = np.add.reduceat(np.log(p), first)
        return logs, np.diff(np.r_[first, len(ch)])
