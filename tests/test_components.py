import random

from scorenet.operators import components
from scorenet.operators.components import _star, connected_components


def brute(edges):
    low = {}
    for u, v in edges:
        low.setdefault(u, u), low.setdefault(v, v)
    while True:
        before = dict(low)
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
        if low == before:
            return low


def test_random_graphs_small_and_by_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame([*edges, *edges[:20], (7, 7), (None, 3)], "u long, v long")
    for small in (200_000, 10):
        got = {r.id: r.comp for r in connected_components(df, small=small).collect()}
        assert got == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_star_of_a_path(spark):
    df = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    assert {(r.u, r.v) for r in _star(df, True).collect()} == {(2, 1), (3, 1)}


def test_rounds_shrink_and_tasks_stay_small(spark, monkeypatch):
    """Every round's edges are far fewer than those before, whatever the order of ids along the paths, and
    nodes of components that are done take no part."""
    sizes = []
    real = components.written

    def counted(df, tag):
        out = real(df, tag)
        if tag == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    monkeypatch.setattr(components, "contracted", lambda edges, whole=False, f=components.contracted: f(edges, True) if whole else edges.distinct())
    n = 20_000
    path = spark.range(1, n).select((components.F.col("id") - 1).alias("u"), components.F.col("id").alias("v")).where("v % 10 > 0 or v < 5000")
    got = connected_components(path, small=50)
    low = components.F.when(components.F.col("id") < 5000, 0).otherwise(components.F.floor(components.F.col("id") / 10) * 10)
    assert got.where(components.F.col("comp") != low).count() == 0 and got.count() == n
    assert len(sizes) > 3 and all(b < 0.8 * a for a, b in zip(sizes[:6], sizes[1:], strict=False))
    assert components.HELD <= 300_000
