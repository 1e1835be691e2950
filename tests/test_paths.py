"""Paths as tables against Dijkstra's walk, and the rule built on them against the optimum."""

import random

from scorenet.graph import ScoredGraph
from scorenet.operators import paths
from scorenet.plans import local, reduce


def network(spark, rng, n, m, least=-6, most=4):
    w = {v: float(rng.randint(least, most)) for v in range(n)}
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    g = ScoredGraph.of(spark.createDataFrame(sorted(w.items()), "id long, score double"), spark.createDataFrame(edges, "u long, v long"))
    return w, edges, g.stored()


def test_all_pairs(spark):
    w, edges, g = network(spark, random.Random(4), 24, 34)
    adj, cost = local.adjacency(edges, w), {v: max(0.0, -x) for v, x in w.items()}
    got = {(r.start, r.id): r for r in paths.all_pairs(g, width=4.0).collect()}
    want = {(a, b): d for a in w for b, d in local.shortest_paths(adj, cost, a)[0].items()}
    assert {k: r.dist for k, r in got.items()} == want
    for (a, b), r in got.items():
        assert (r.pred is None) == (a == b)
        assert r.pred is None or (r.pred in adj[b] and got[a, r.pred].dist + cost[b] == r.dist)


def test_nearest_sources(spark):
    w, edges, g = network(spark, random.Random(9), 30, 40)
    adj, cost = local.adjacency(edges, w), {v: max(0.0, -x) for v, x in w.items()}
    starts = [3, 11, 20]
    each = {s: local.shortest_paths(adj, cost, s)[0] for s in starts}
    got = {r.id: (r.dist, r.source) for r in paths.nearest_sources(g, g.nodes.where("id in (3, 11, 20)")).collect()}
    assert got == {v: min((d[v], s) for s, d in each.items() if v in d) for v in w if any(v in d for d in each.values())}


def test_long_detours_go_and_the_optimum_stays(spark):
    """Node 0 joins 1 and 9 for 7; around it lead seven nodes that cost 6 together."""
    w = {0: -7.0, 1: 5.0, 9: 5.0, **dict.fromkeys((2, 3, 4, 5, 6, 7), -1.0), 8: 0.0}
    edges = [(0, 1), (0, 9), *((k, k + 1) for k in range(1, 9))]
    g = ScoredGraph.of(spark.createDataFrame(sorted(w.items()), "id long, score double"), spark.createDataFrame(edges, "u long, v long"))
    # The others are candidates too, but each has only the dear way around.
    assert [r.id for r in reduce.shortest_path(g).collect()] == [0]


def best(w, edges):
    left, total = set(w), 0.0
    adj = local.adjacency(edges, w)
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += adj[x]
        left -= part
        own = [e for e in edges if e[0] in part]
        total = max(total, local.solve_component({v: w[v] for v in part}, own)[0])
    return total


def test_rule_keeps_the_optimum(spark):
    gone = 0
    for seed in range(2):
        rng = random.Random(seed)
        ring = 12
        w, edges, _ = network(spark, rng, ring, 10, -3, 3)
        edges = sorted({*edges, *((k, k + 1) for k in range(ring - 1)), (0, ring - 1)})
        g = ScoredGraph.of(spark.createDataFrame(sorted(w.items()), "id long, score double"), spark.createDataFrame(edges, "u long, v long")).stored()
        out = {r.id for r in reduce.shortest_path(g).collect()}
        gone += len(out)
        assert best({v: x for v, x in w.items() if v not in out}, [e for e in edges if not out & set(e)]) == best(w, edges)
    assert gone
