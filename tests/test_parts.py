"""Small components in tasks: the same as by tables, and within bounds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorenet import queries as q
from scorenet.graph import ScoredGraph
from scorenet.operators import components, paths, topology
from scorenet.plans import draws, part_rules, reduce, solve

SF = "/root/testdata/sf0.001"


def mixed(spark, seed=3, parts=40):
    rng = random.Random(seed)
    nodes, edges = [], set()
    for p in range(parts):
        n = rng.randint(1, 9) if p else 40
        nodes += [(100 * p + v, float(rng.randint(-9, 9))) for v in range(n)]
        edges |= {tuple(sorted((100 * p + rng.randrange(n), 100 * p + rng.randrange(n)))) for _ in range(2 * n)}
    return ScoredGraph.of(spark.createDataFrame(nodes, "id long, score double"), spark.createDataFrame(sorted(edges), "u long, v long")).stored()


def test_tasks_hold_a_bounded_number_of_edges():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 50_000, (2, 60_000))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 5000]), pa.array(v[i : i + 5000])], names=["u", "v"]) for i in range(0, len(u), 5000)]
    read = 0

    def counted():
        nonlocal read
        for b in batches:
            read += 1
            yield b

    next(components._contract(counted(), 10_000))
    assert read < len(batches)  # rows go on before all are held
    got = pa.Table.from_batches(components._contract(iter(batches), 10_000))
    a = components.forest(u, v)
    b = components.forest(got.column("u").to_numpy(), got.column("v").to_numpy())
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    read = 0
    rows = [pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(rng.random(5000)), x.column(0), x.column(1)], names=["cu", "cv", "cost", "u", "v"]) for x in batches]
    batches, plain = rows, pa.Table.from_batches(rows)
    next(topology._light_edges(counted(), 10_000))
    assert read < len(batches)
    light = pa.Table.from_batches(topology._light_edges(iter(rows), 10_000))
    assert topology._forest_of(light).to_pydict() == topology._forest_of(plain).to_pydict()


def test_blocks_of_parts(spark):
    g = mixed(spark)
    want = sorted(map(tuple, topology.blocks_by_tables(g).collect()))
    for whole in (10_000, 8):
        assert sorted(map(tuple, topology.blocks(g, whole=whole).collect())) == want


@pytest.mark.parametrize("hubs", [False, True])
def test_draws_of_parts(spark, hubs):
    g = mixed(spark, 7, 12)
    got = [draws.best_of_draws(g, 2, hubs=hubs, whole=whole) for whole in (0, 10_000, 8)]
    sets = [sorted(r.id for r in ids.collect()) for _, ids in got]
    assert got[0][0] == got[1][0] == got[2][0] and sets[0] == sets[1] == sets[2]


def test_no_search_for_short_detours(spark, monkeypatch):
    """Candidates with the same two neighbours are not searched, but for the best of each pair."""
    asked = []
    real = paths.least_costs
    monkeypatch.setattr(reduce, "least_costs", lambda arcs, costs, start, *more: asked.append(start.count()) or real(arcs, costs, start, *more))
    nodes = [(0, 1.0), (1, 1.0), *((k, -float(k)) for k in range(2, 12)), (12, 1.0), (13, 1.0), (14, -3.0)]
    edges = [(x, k) for k in range(2, 12) for x in (0, 1)] + [(12, 13), (12, 14), (13, 14)]
    g = ScoredGraph.of(spark.createDataFrame(nodes, "id long, score double"), spark.createDataFrame(edges, "u long, v long"))
    assert sorted(r.id for r in reduce.shortest_path(g).collect()) == [*range(3, 12), 14]
    assert asked == [1]


def test_permutations_search_what_can_win(spark):
    g = q._graph(spark, SF)
    want = {(r.rep, r.value) for r in solve.permutation_null(g, 2, at_once=100_000).collect()}
    assert {(r.rep, r.value) for r in solve.permutation_null(g, 2, at_once=2).collect()} == want


def test_kind_finds_components_once(spark, monkeypatch):
    calls = []
    real = topology.components
    monkeypatch.setattr(topology, "components", lambda g: calls.append(1) or real(g))
    assert q.network_kind(spark, SF).first().is_forest and calls == [1]


def test_edges_are_dealt_by_rows(spark, monkeypatch):
    """A task that drops repeated edges has a bounded number of rows, however few bytes they take."""
    from pyspark.sql import functions as F

    from scorenet import graph

    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    raw = spark.range(5000).select((F.col("id") % 2000).alias("u"), (F.col("id") % 2000 + 1).alias("v"))
    g = ScoredGraph.of_ends(spark.range(2001).select("id", F.lit(1.0).alias("score")), raw)
    sizes = [r["count"] for r in g.edges.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 == g.edges.distinct().count() and len(sizes) == 10 and max(sizes) <= 500
    nodes = [r["count"] for r in g.nodes.groupBy(F.input_file_name()).count().collect()]
    assert sum(nodes) == 2001 and len(nodes) == 8


def as_part(g):
    nodes, edges = sorted(map(tuple, g.nodes.select("id", "score", "is_root").collect())), g.edges.collect()
    at = {r[0]: i for i, r in enumerate(nodes)}
    u, v = (np.array([at[x] for x in c]) for c in zip(*edges, strict=True))
    comp = components.merge_labels(np.arange(len(at)), u, v)
    return np.array([*at]), part_rules.Part(comp, np.array([r[1] for r in nodes]), np.array([r[2] for r in nodes]), u, v)


@pytest.mark.parametrize("name", ["neg_deg01", "pos_edges", "neg_chain_edges", "pos_diamond", "mirrored_hubs", "shortest_path"])
def test_array_rules(spark, name, monkeypatch):
    """Each rule finds in arrays what it finds in tables; searches for detours go in several chunks."""
    monkeypatch.setattr(part_rules, "SEARCHED", 30)
    extra = [(90_000 + 10 * k + i, float(s)) for k in range(8) for i, s in enumerate([-3 + k % 3, -3, 5, 4 - k % 2, 5, -2, -1, -1])]
    edges = [(90_000 + 10 * k + a, 90_000 + 10 * k + b) for k in range(8) for a, b in [(0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), *([(4, 5), (5, 6), (6, 7), (7, 4)] if k % 2 else [])]]
    g = mixed(spark, 5)
    g = ScoredGraph.of(g.nodes.select("id", "score").union(spark.createDataFrame(extra, "id long, score double")), g.edges.union(spark.createDataFrame(edges, "u long, v long")))
    g = g.with_roots(spark.createDataFrame([(0,), (101,), (90_000,), (90_021,)], "id long")).stored()
    ids, p = as_part(g)
    got = getattr(part_rules, name)(p)
    want = sorted(map(tuple, getattr(reduce, name)(g).collect()))
    assert want and want == sorted(zip(ids[p.u[got]].tolist(), ids[p.v[got]].tolist()) if got.dtype == bool else ((x,) for x in ids[got].tolist()))


def test_reduction_of_parts(spark):
    """Small components settle in tasks as they do by tables, but for the ids of copied leaves."""
    g = mixed(spark, 5)
    top = g.nodes.agg({"id": "max"}).first()[0]

    def known(t, name):
        return sorted(map(tuple, t.withColumn(name, F.least(name, F.lit(top + 1))).collect()), key=str)

    want = reduce.reduced(g, reduce.PHASES)
    got, more = reduce._small_parts(g, 1000)
    assert not more
    assert known(got.nodes, "id") == known(want.nodes, "id")
    assert known(got.edges, "u") == known(want.edges, "u")
    assert known(got.node_map, "pre_id") == known(want.node_map, "pre_id")


def test_reduction_of_parts_needs_no_rules_on_tables(spark, monkeypatch):
    """Networks of small components settle without a round on tables; larger ones go on as tables."""
    rounds = []
    monkeypatch.setattr(reduce, "PHASES", [[lambda g: (g, bool(rounds.append(1)))]])
    g = mixed(spark, 5)
    reduce.reduced(g)
    assert not rounds
    reduce.reduced(g, whole=8)
    assert rounds
