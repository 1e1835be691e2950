"""Trees and blocks as tables against plain walks, with rounds forced by a limit of no rows."""

import random

import pytest
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.operators import analysis, topology, trees
from scorenet.plans import local


def random_forest(rng, n, shape):
    """(id, parent) in no order of ids."""
    ids = rng.sample(range(10 * n), n)
    out = []
    for k, i in enumerate(ids):
        if not k or rng.random() < 0.05:
            out.append((i, None))
        elif shape == "path":
            out.append((i, ids[k - 1]))
        elif shape == "star":
            out.append((i, ids[0]))
        else:
            out.append((i, rng.choice(ids[max(0, k - 6) : k])))
    return out


def walked(rows, scores, fold):
    kids = {}
    for i, p in rows:
        kids.setdefault(p, []).append(i)
    out = {}
    order, todo = [], list(kids.get(None, []))
    while todo:
        i = todo.pop()
        order.append(i)
        todo += kids.get(i, [])
    for i in reversed(order):
        out[i] = fold(scores[i], [out[c] for c in kids.get(i, [])])
    return out


def all_shapes(rng, n=50):
    """A forest of paths, stars and other trees."""
    out = []
    for k, shape in enumerate(("path", "star", "any")):
        out += [(i + 10_000 * k, None if p is None else p + 10_000 * k) for i, p in random_forest(rng, n, shape)]
    return out


@pytest.mark.parametrize("small", [0, 10_000])
def test_values_of_subtrees(spark, small):
    rng = random.Random(small)
    rows = all_shapes(rng)
    scores = {i: rng.randrange(-9, 8) for i, _ in rows}
    tree = spark.createDataFrame([(i, p, scores[i]) for i, p in rows], "id long, parent long, score long")
    got = {r.id: r.value for r in analysis.tree_values(tree, small).collect()}
    assert got == walked(rows, scores, lambda own, parts: own + sum(max(0, x) for x in parts))
    both = tree.select("id", "parent", F.col("score").alias("a"), (-F.col("score")).alias("b"))
    most = {r.id: (r.a, -r.b) for r in trees.subtree_values(both, ["a", "b"], trees.Most, max(small, 20)).collect()}
    high, low = (walked(rows, scores, lambda own, parts, f=f: f([own, *parts])) for f in (max, min))
    assert most == {i: (high[i], low[i]) for i in scores}


def test_rounds_of_a_long_path(spark):
    """A path of 10^5 nodes in few rounds; none of them would end it level by level."""
    n = 100_000
    path = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") % 3 - 1).alias("score"))
    got = trees.subtree_values(path.withColumnRenamed("score", "value"), ["value"], trees.Gain, small=20_000, most_rounds=12)
    top = got.where("id = 0").first().value
    value = 0
    for i in range(n - 1, -1, -1):
        value = i % 3 - 1 + max(0, value)
    assert top == value and got.count() == n


def test_circles_and_no_rows(spark):
    ring = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (5, None, 1)], "id long, parent long, score long")
    with pytest.raises(Exception, match="not a forest"):
        analysis.tree_values(ring).collect()
    with pytest.raises(ValueError, match="not a forest"):
        trees.subtree_values(ring.withColumnRenamed("score", "value"), ["value"], small=0, most_rounds=8)
    assert analysis.tree_values(ring.limit(0)).count() == 0
    assert trees.rooted(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_rooted(spark, small):
    rows = all_shapes(random.Random(3))
    edges = spark.createDataFrame([(min(i, p), max(i, p)) for i, p in rows if p is not None], "u long, v long")
    got = {r.id: r for r in trees.rooted(edges, small).collect()}
    assert {frozenset((r.id, r.parent)) for r in got.values() if r.parent is not None} == {frozenset((i, p)) for i, p in rows if p is not None}

    def up(i):
        while i is not None:
            yield i
            i = got[i].parent

    for a in got.values():
        *_, top = up(a.id)
        assert top == a.root == min(x.id for x in got.values() if x.root == a.root)
        for b in got.values():
            if a.root == b.root:
                assert (b.first <= a.first <= b.last) == (b.id in set(up(a.id)))


def networks():
    """Networks of several kinds side by side."""
    rng, out = random.Random(8), {(k, k + 1) for k in range(40)} | {(k, k + 3) for k in range(0, 36, 6)}
    for at, (n, m) in enumerate(((12, 11), (30, 33), (60, 70), (40, 200))):
        out |= {tuple(sorted(rng.sample(range(100 * at + 100, 100 * at + 100 + n), 2))) for _ in range(m)}
    return out


@pytest.mark.parametrize("small", [20, 10_000])
def test_blocks(spark, small):
    edges = networks()
    g = ScoredGraph.of(spark.range(600).select("id", F.lit(1.0).alias("score")), spark.createDataFrame(sorted(edges), "u long, v long"))
    parts, comps = {}, {}
    for r in topology.blocks(g, small).collect():
        parts.setdefault((r.comp, r.block), []).append((r.u, r.v))
        comps.setdefault(r.comp, set()).add(r.block)
    assert sorted(sorted(p) for p in parts.values()) == sorted(local.biconnected(sorted(edges)))
    assert all(b == set(range(len(b))) for b in comps.values())
    assert topology.blocks(topology.induced(g, g.nodes.limit(0))).count() == 0


def test_block_cut_tree(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (8, 9)]
    g = ScoredGraph.of(spark.range(10).select("id", F.lit(1.0).alias("score")), spark.createDataFrame(edges, "u long, v long"))
    got = sorted((r.cut_id, r.block_degree) for r in topology.block_cut_tree(g).collect())
    assert got == [(3, 1), (3, 2), (4, 1), (4, 2)]
    assert topology.articulation_points(g).count() == 2
