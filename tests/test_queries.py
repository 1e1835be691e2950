"""Each query with SQL against DuckDB, and the others against properties."""

import duckdb
import pytest

from scorenet import queries as q
from scorenet.plans import local

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(q.ORACLES[name])
    cols = [c[0] for c in got.description]
    df = q.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, got.fetchall()))


def test_solvers_agree(spark):
    exact = q.mwcs_exact(spark, SF).first()
    drawn = q.monte_carlo(spark, SF).first()
    assert exact.status == "OPTIMAL" and drawn.score <= exact.score
    assert abs(sum(r.score for r in q.flagship(spark, SF).collect()) - exact.score) < 1e-6
    assert q.mwcs_rooted(spark, SF).first().score <= exact.score


def test_reduction_keeps_optimum(spark):
    from scorenet.plans import solve

    g = q._graph(spark, SF)
    assert solve.solve(g).bounds.first().score == solve.solve(g, reduce=False).bounds.first().score


def test_cut_node_pays_for_two_gains():
    w = {0: -10.0}
    edges = []
    for k in (1, 6):
        w |= {k: 4.0, k + 1: 4.0, k + 2: -100.0, k + 3: -100.0, k + 4: -100.0}
        edges += [(0, k), (0, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3), (k + 3, k + 4), (k + 2, k + 4), (k, k + 4), (k + 1, k + 2)]
    value, ids, _, status = local.solve_component(w, edges)
    assert (value, ids, status) == (6.0, [0, 1, 2, 6, 7], "OPTIMAL")


def test_spanning_forest(spark):
    edges = [(r.u, r.v) for r in q._graph(spark, SF, "dense").edges.collect()]
    cost = {e: e[0] * 7 % 101 + e[1] % 13 for e in edges}
    tree = local.spanning_tree({x for e in edges for x in e}, edges, cost)
    got = q.msf_weight(spark, SF).first()
    assert (got.weight, got.n_edges) == (sum(cost[e] for e in tree), len(tree))


@pytest.mark.parametrize("name", ["induced_subgraph", "pos_leaf_sum", "pos_edge_contract", "neg_chain_contract", "neg_circuit", "neg_diamond", "mirrored_hubs", "pos_diamond", "dominated_hubs"])
def test_rules_fire(spark, name):
    least = 1 if name == "pos_diamond" else 20  # both hubs of few customers are negative and all orders positive
    assert q.QUERIES[name](spark, SF).limit(least).count() == least


def test_random_and_toy_graphs(spark):
    from scorenet.operators import analysis
    from scorenet.plans import solve
    from scorenet.sources import text

    g = analysis.random_graph(spark, 60, 300, 4)
    assert g.nodes.count() == 60 and 220 < g.edges.count() < 380
    assert g.edges.where("u < 1 or v > 60 or u >= v").count() == 0
    full = analysis.random_graph(spark, 9, 36)
    assert full.edges.count() == 36
    eight, three = text.toy_graphs(spark)
    assert [solve.solve(x, reduce=False).bounds.first().score for x in (eight, three)] == [36.0, 9.0]
