"""Monte Carlo over whole networks: exact on forests, a connected set's sum elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.plans import draws, local, solve


def network(spark, rng, n, m, roots=()):
    w = {v: float(rng.randint(-9, 9)) for v in range(n)}
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    nodes = spark.createDataFrame([(v, x, v in roots) for v, x in w.items()], "id long, score double, is_root boolean")
    return w, edges, ScoredGraph.of(nodes, spark.createDataFrame(edges, "u long, v long")).stored()


def whole(edges, ids):
    adj = local.adjacency(edges, ids)
    seen, todo = set(), [min(ids)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += adj[x] & ids
    return seen == ids


@pytest.mark.parametrize("small", [10, 100_000])
def test_forests_are_solved(spark, small):
    rng = random.Random(2)
    w = {v: float(rng.randint(-5, 5)) for v in range(60)}
    parts = [range(0, 20), range(20, 41), range(41, 60)]
    edges = [(rng.randrange(max(p[0], v - 4), v), v) for p in parts for v in p[1:]]
    g = ScoredGraph.of(spark.createDataFrame(sorted(w.items()), "id long, score double"), spark.createDataFrame(edges, "u long, v long"))
    value, ids = draws.best_of_draws(g, 1, small=small)
    ids = {r.id for r in ids.collect()}
    want = max(local.tree_dp({v: w[v] for v in p}, [e for e in edges if e[1] in p])[0] for p in parts)
    assert value == want == sum(w[v] for v in ids) and whole(edges, ids)


def test_drawn_sets(spark):
    w, edges, g = network(spark, random.Random(1), 25, 45)
    got = solve.monte_carlo(g, 3, "uniform_random", reduce=False, hubs=True)
    row, ids = got.bounds.first(), {r.id for r in got.ids.collect()}
    assert row.score == sum(w[v] for v in ids) <= row.ub and whole(edges, ids) and row.score >= max(w.values())
    lo, hi = min(w.values()), max(w.values())
    for strategy in draws.STRATEGIES:
        costs = draws.drawn_costs(g, [0, 1], strategy).collect()
        assert sorted({(r.u, r.v) for r in costs}) == edges and len(costs) == 2 * len(edges)
        for r in costs:
            scaled = [(w[x] - lo) / (hi - lo) for x in (r.u, r.v)]
            exact = {"fixed": -(w[r.u] + w[r.v]), "min_max": 2 - sum(scaled)}.get(strategy)
            least = 2 - sum(scaled) if strategy == "uniform_random" else 0.0
            assert abs(r.cost - exact) < 1e-9 if exact is not None else least <= r.cost <= 2


def test_roots_are_held(spark):
    w, edges, g = network(spark, random.Random(5), 25, 60, roots=(3, 17))
    value, ids = draws.best_of_draws(g, 3)
    ids = {r.id for r in ids.collect()}
    assert {3, 17} <= ids and whole(edges, ids) and value == sum(w[v] for v in ids)
    apart = g.without_edges(g.edges.where("u = 3 or v = 3"))
    assert solve.monte_carlo(apart, 2, reduce=False).bounds.first().status == "INFEASIBLE"


def test_hubs_are_drawn_by_benefit(spark):
    nodes = [(0, -2.0), *((v, 3.0) for v in range(1, 6))]
    edges = [(0, v) for v in range(1, 6)] + [(1, 2), (2, 3)]
    g = ScoredGraph.of(spark.createDataFrame(nodes, "id long, score double"), spark.createDataFrame(edges, "u long, v long"))
    assert [(r.draw, r.id) for r in draws.sampled_hubs(g, [0, 1], 0).orderBy("draw").collect()] == [(0, 0), (1, 0)]
    cost = draws.drawn_costs(g, [0], hubs=True)
    assert cost.where("u = 0").agg(F.max("cost")).first()[0] < 1e-3 < cost.where("u <> 0").agg(F.min("cost")).first()[0]
    assert solve.monte_carlo(g, 1, reduce=False, hubs=True).bounds.first().score == 13.0
    empty = ScoredGraph.of(g.nodes.limit(0), g.edges.limit(0))
    assert solve.monte_carlo(empty, 1, reduce=False).bounds.first().score == 0.0
