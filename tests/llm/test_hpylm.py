"""The Pitman-Yor model: seating against enumeration, context words, and independence of partitions."""

import math
from itertools import product

import numpy as np

from scorenet.llm import hpylm
from scorenet.llm.seating import Seating, log_seatings


def test_seatings_by_recursion_of_partitions():
    """Weights of all partitions of five customers, by number of tables."""
    d, want = 0.3, {}

    def put(sizes, n, weight):
        if n == 5:
            want[len(sizes)] = want.get(len(sizes), 0.0) + weight
            return
        put([*sizes, 1], n + 1, weight)
        for i, k in enumerate(sizes):
            put([*sizes[:i], k + 1, *sizes[i + 1 :]], n + 1, weight * (k - d))

    put([1], 1, 1.0)
    got = log_seatings(d)
    assert all(math.isclose(math.exp(got[5, t]), w) for t, w in want.items())


def test_tables_against_enumeration():
    """Long runs of the Gibbs step give the exact distribution of the tables of three dishes."""
    customers, base, d, strength = np.array([4, 2, 3]), np.array([0.5, 0.2, 0.05]), 0.4, 1.0
    s = log_seatings(d)
    weight = {}
    for t in product(*(range(1, c + 1) for c in customers)):
        opened = np.log(strength + d * np.arange(sum(t))).sum()
        weight[t] = math.exp(opened + sum(k * math.log(b) + s[c, k] for k, b, c in zip(t, base, customers)))
    total = sum(weight.values())
    mean = [sum(t[i] * w for t, w in weight.items()) / total for i in range(3)]
    many = 20_000  # restaurants alike, each a chain of its own
    seats = Seating(np.repeat(np.arange(many), 3), np.tile(customers, many), many, d, strength, np.random.default_rng(5))
    for _ in range(12):
        seats.sweep(np.tile(base, many))
    assert np.allclose(seats.tables.reshape(many, 3).mean(0), mean, atol=0.04)
    own, left = seats.parts()
    assert np.allclose(np.bincount(seats.place, own) + left, 1)


def test_many_customers():
    seats = Seating(np.zeros(2, int), np.array([100_000, 70]), 1, 0.5, 1.0, np.random.default_rng(1))
    for _ in range(5):
        seats.sweep(np.array([0.5, 0.01]))
    assert 1 < seats.tables[0] <= 100_000 and 1 <= seats.tables[1] <= 70


def frame(spark):
    rng = np.random.default_rng(2)
    pairs = [("red", "apple"), ("blue", "sky"), ("green", "grass"), ("old", "house")]
    rows = [(i, " ".join(" ".join(pairs[k]) for k in rng.integers(0, 4, 30))) for i in range(200)]
    return spark.createDataFrame([*rows, (1000, "red apple blue sky"), (1001, "apple red sky blue"), (1002, "red apple unheard")], "doc_id long, text string")


def test_contexts_and_partitions(spark, monkeypatch):
    docs = frame(spark)
    got = {r.doc_id: r.score for r in hpylm.score(docs).collect()}
    assert got[1000] > got[1001] + 2  # the same words, in an order never seen
    again = {r.doc_id: r.score for r in hpylm.score(docs.repartition(5)).collect()}
    assert got.keys() == again.keys() and all(math.isclose(got[i], again[i], rel_tol=1e-9) for i in got)
    table = {r.held_out: r for r in hpylm.perplexity(hpylm.score(docs)).collect()}
    assert table[True].model < 0.7 * table[True].base
    # Words with several restaurants, many shards and small chunks change what is a restaurant, not what counts.
    for name, x in (("UNIT", 300), ("SHARD_TOKENS", 500), ("CHUNK_TOKENS", 700)):
        monkeypatch.setattr(hpylm, name, x)
    rows = hpylm.score(docs).collect()
    base = {r.doc_id: (r.n_tokens, r.n_known, r.base_score) for r in hpylm.score(docs).collect()}
    for r in rows:
        assert (r.n_tokens, r.n_known) == base[r.doc_id][:2] and math.isclose(r.base_score, base[r.doc_id][2])
    split = {r.doc_id: r.score for r in rows}
    assert split[1000] > split[1001] + 2
