"""Graph algorithms of one component against brute force, and the solver when its time is up."""

import random
from itertools import combinations, permutations

import pytest

from scorenet.plans import local
from tests import instances


def graph(rng, n, m):
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return {v: float(rng.randint(-9, 9)) for v in range(n)}, edges


def connected(adj, ids):
    todo, seen = [min(ids)], {min(ids)}
    while todo:
        for y in adj[todo.pop()] & ids - seen:
            seen.add(y)
            todo.append(y)
    return seen == ids


def best_of_all(nodes, edges, roots=frozenset()):
    adj = local.adjacency(edges, nodes)
    sets = (set(c) for k in range(1, len(nodes) + 1) for c in combinations(nodes, k))
    values = [sum(nodes[v] for v in c) for c in sets if roots <= c and connected(adj, c)]
    return max([*values, *([] if roots else [0.0])])


@pytest.mark.parametrize("seed", range(30))
def test_optimum(seed):
    rng = random.Random(seed)
    nodes, edges = graph(rng, 10, 14)
    adj = local.adjacency(edges, nodes)
    parts, left = [], set(nodes)
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            for y in adj[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        parts.append(seen)
        left -= seen
    for part in parts:
        sub = {v: nodes[v] for v in part}
        own = [e for e in edges if e[0] in part]
        for roots in (frozenset(), frozenset([min(part)]), frozenset([min(part), max(part)])):
            value, ids, bound, status = local.solve_component(sub, own, roots)
            assert status == "OPTIMAL" and value == bound == best_of_all(sub, own, roots) == sum(sub[v] for v in ids)
            for seconds in (0.0, 1e-4):  # out of time: a connected set, and a bound that holds
                low, ids, bound, _ = local.solve_component(sub, own, roots, seconds, draws=0)
                assert low <= value <= bound + 1e-9
                assert roots <= set(ids) and (not ids or connected(adj, set(ids))) and low == sum(sub[v] for v in ids)


def test_time_is_up_in_a_chain():
    """Three triangles in a row with no time at all: the bound is not below the optimum."""
    w = {v: 5.0 for v in range(7)} | {2: -1.0, 4: -1.0}
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5), (5, 6), (4, 6)]
    value, ids, bound, _ = local.solve_component(w, edges, seconds=0.0)
    assert bound >= 23.0 >= value and value == sum(w[v] for v in ids)


@pytest.mark.parametrize("text", [instances.weighted(1500, 5000, 1), *(open(p).read() for k, p in instances.given() if k == "stp")])
def test_large_instance_in_seconds(text):
    x = instances.parse_stp(text)
    edges = [e[:2] for e in x["edges"]]
    drawn, _ = local.monte_carlo(x["terminals"], edges, seeds=range(5))
    value, ids, bound, _ = local.solve_component(x["terminals"], edges, seconds=6.0, draws=5)
    assert 0 < drawn <= value <= bound and connected(local.adjacency(edges, x["terminals"]), set(ids))


@pytest.mark.parametrize("seed", range(20))
def test_paths_and_flow(seed):
    rng = random.Random(seed)
    _, edges = graph(rng, 7, 11)
    adj = local.adjacency(edges, range(7))
    cost = {v: float(rng.randint(0, 5)) for v in range(7)}
    simple = [p for k in range(6) for mid in permutations(range(1, 6), k) for p in [(0, *mid, 6)] if all(b in adj[a] for a, b in zip(p, p[1:]))]
    price = {p: sum(cost[v] for v in p[1:]) for p in simple}
    dist, before = local.shortest_paths(adj, cost, 0)
    assert dist.get(6) == (min(price.values()) if simple else None)
    sets = [(x,) for x in simple] + [(x, y) for x, y in combinations(simple, 2) if not set(x[1:-1]) & set(y[1:-1])]
    two = [x for x in sets if len(x) == 2]
    got = local.disjoint_paths(adj, cost, 0, 6, 2)
    assert len(got) == (2 if two else 1 if simple else 0)
    if got:
        assert all(tuple(p) in price for p in got)
        assert sum(price[tuple(p)] for p in got) == min(sum(price[p] for p in x) for x in (two or sets))
    arcs = [(u, v, float(rng.randint(1, 4))) for a, b in edges for u, v in ((a, b), (b, a))]
    cuts = [sum(c for u, v, c in arcs if u in s and v not in s) for k in range(6) for mid in combinations(range(1, 6), k) for s in [{0, *mid}]]
    value, near, far = local.max_flow(arcs, 0, 6)
    assert value == min(cuts) == sum(c for u, v, c in arcs if u in near and v not in near) == sum(c for u, v, c in arcs if u not in far and v in far)


def test_dependent_pairs():
    nodes = {0: 0.5, 1: -1.0, 2: 5.0, 3: -9.0, 4: 2.0}
    assert local.dependent_pairs(nodes, [(0, 1), (1, 2), (2, 3), (3, 4)]) == [(0, 2)]
    assert local.is_path_ok([-1.0, 3.0]) and not local.is_path_ok([3.0, -1.0]) and not local.is_path_ok([-3.0, 1.0])


def test_hub_sampling():
    nodes = {0: -2.0, **{v: 3.0 for v in range(1, 6)}}
    edges = [(0, v) for v in range(1, 6)] + [(1, 2), (2, 3)]
    cost = local.edge_costs(nodes, edges, "random", 1)
    got = local.hub_costs(nodes, edges, cost, 1)
    assert all(got[0, v] < 1e-3 for v in range(1, 6)) and got[1, 2] == cost[1, 2]
    assert local.monte_carlo(nodes, edges, hubs=True)[0] == 13.0


def test_negative_parts_are_trimmed():
    """Between 0 and 3 lie a part with a positive node, and one of four negative nodes with two paths."""
    w = {0: 5.0, 3: 5.0, 1: 1.0, 2: -1.0, 4: -2.0, 5: -2.0, 6: -1.0, 7: -1.0}
    edges = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 3), (0, 6), (6, 7), (7, 3), (4, 6), (5, 7)]
    adj = local.adjacency(edges)
    assert (0, 3) in {(p, q) for p, q, _ in local.separation_pairs(adj)}
    assert set(local.trimmed(adj, w, set())) == {0, 1, 2, 3, 6, 7}
    assert set(local.trimmed(adj, w, {4})) == set(adj)
    assert set(local.trimmed(local.adjacency([*edges, (0, 3)]), w, set())) == {0, 1, 2, 3}


@pytest.mark.parametrize("seed", range(40))
def test_trimming_keeps_the_optimum(seed):
    rng = random.Random(100 + seed)
    ring = [(v, (v + 1) % 9) for v in range(9)]
    edges = sorted({tuple(sorted(e)) for e in ring} | {tuple(sorted(rng.sample(range(9), 2))) for _ in range(rng.randrange(4))})
    nodes = {v: float(rng.choice([-4, -3, -2, -1, -1, 3, 6])) for v in range(9)}
    adj = local.adjacency(edges)
    small = local.trimmed(adj, nodes, set())
    left = [(u, v) for u in small for v in small[u] if u < v]
    assert best_of_all({v: nodes[v] for v in small}, left) == best_of_all(nodes, edges)
