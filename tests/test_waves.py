"""Search by waves of blocks against brute force, with states dealt over several rounds."""

import random
from itertools import combinations

from scorenet.graph import ScoredGraph
from scorenet.plans import local, solve, waves


def clusters(rng, n_parts, size, extra):
    """Parts of a few blocks each that hang together at cut nodes."""
    w, edges = {}, set()
    for p in range(n_parts):
        at, last = 100 * p, None
        for _ in range(2):
            ids = list(range(at, at + size)) if last is None else [last, *range(at, at + size - 1)]
            edges |= {tuple(sorted(e)) for e in zip(ids, [*ids[1:], ids[0]])}
            edges |= {tuple(sorted(rng.sample(ids, 2))) for _ in range(extra)}
            w |= {v: float(rng.choice([-5, -3, -2, -1, -1, 2, 4])) for v in ids if v not in w}
            at, last = max(ids) + 1, rng.choice(ids)
        edges.add((last, at))
        w[at] = 1.0
    return w, sorted(edges)


def best_of_all(w, edges, roots=frozenset()):
    adj = local.adjacency(edges, w)
    best = float("-inf") if roots else 0.0
    for part in {x // 100 for x in w}:
        own = [v for v in w if v // 100 == part]
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                s = set(c)
                if roots <= s and (value := sum(w[v] for v in c)) > best and waves._whole({v: adj[v] & s for v in s}, s):
                    best = value
    return best


def network(spark, w, edges, roots=()):
    nodes = spark.createDataFrame([(v, x, v in roots) for v, x in w.items()], "id long, score double, is_root boolean")
    return ScoredGraph.of(nodes, spark.createDataFrame(edges, "u long, v long")).stored()


def test_optimum_by_waves(spark):
    rng = random.Random(1)
    w, edges = clusters(rng, 6, 6, 3)
    got = solve.solve(network(spark, w, edges), reduce=False, whole=0)
    row, ids = got.bounds.first(), {r.id for r in got.ids.collect()}
    adj = local.adjacency(edges, w)
    assert (row.score, row.ub, row.status) == (best_of_all(w, edges),) * 2 + ("OPTIMAL",)
    assert row.score == sum(w[v] for v in ids) and waves._whole({v: adj[v] & ids for v in ids}, ids)
    assert got.trace and got.trace[-1][1] <= row.score and [v for _, v in got.trace] == sorted(v for _, v in got.trace)


def test_states_over_rounds_and_time(spark, monkeypatch):
    rng = random.Random(7)
    w, edges = clusters(rng, 2, 7, 4)
    want = best_of_all(w, edges)
    monkeypatch.setattr(waves, "MORE_STEPS", 4)
    g = network(spark, w, edges)
    rows = waves.by_waves(g, 300.0, steps=3).collect()
    top = max(r.value for r in rows if r.value is not None)
    assert top == want == sum(w[r.id] for r in rows if r.value == top and r.comp == min(x.comp for x in rows if x.value == top))
    rows = waves.by_waves(g, 0.0, steps=3).collect()  # no time at all: bounds hold
    assert all(r.value is None or r.value <= want for r in rows) and max(r.bound for r in rows) >= want


def test_roots_by_waves(spark):
    rng = random.Random(3)
    w, edges = clusters(rng, 1, 6, 2)
    for roots in ({min(w), max(w)},):
        got = solve.solve(network(spark, w, edges, roots), reduce=False, whole=0)
        ids = {r.id for r in got.ids.collect()}
        assert got.bounds.first().score == best_of_all(w, edges, frozenset(roots)) == sum(w[v] for v in ids) and roots <= ids
    lone = ScoredGraph.of(spark.createDataFrame([(1, 3.0), (2, -1.0)], "id long, score double"), spark.createDataFrame([], "u long, v long"))
    assert solve.solve(lone, reduce=False, whole=0).bounds.first().score == 3.0
