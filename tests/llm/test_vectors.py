"""Whitening against plain NumPy and integers, and its odd cases."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from scorenet.llm import queries as q
from scorenet.llm import stable_search, whitening

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<float>, n long, v string, component int"


def frame(spark, rows, kinds=KINDS):
    return spark.createDataFrame([(*r, 7, "v", 1) for r in rows], kinds)


def test_op12_whitening(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = {r["vec_id"]: int(t) for r, t in zip(rows, ((n * x - s) ** 2).sum(axis=1), strict=True)}
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    z = y @ axes[:, :32] / np.sqrt(e[:32])
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    got = q.op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    got = got.collect()
    assert len(got) == n * 32 and len({(r.vec_id, r.component) for r in got}) == n * 32
    back = np.zeros((n, 32))
    for r in got:
        assert r.n == n and r.deviation == dev[r.vec_id]
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9)
        back[at[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((back * z).sum(axis=0))
    assert np.abs(back * signs - z).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(back.T @ back / n - np.eye(32)).max() < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.5]), (2, [2.0, 0.5]), (None, [0.0, 3.0]), (4, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted(
        [(i, k, 4) for i in ("1", "2", "2", "None") for k in (1, 2)] + [("10", k, 1) for k in (1, 2, 3)]
    )
    for r in got:
        if r.vec_id == 10:
            assert (r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0)
        else:
            assert math.isfinite(r.whitened) and r.identity_error < 1e-9
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in flat if r.component == 2) == [(1, 2, None), (2, 2, None)]
    with pytest.raises(Exception, match="can't be whitened"):
        whitening.whiten(frame(spark, [(1, [1e30])])).collect()


def test_whitening_of_sums_beyond_64_bits():
    x = whitening.as_steps(np.array([[2.0**30, -(2.0**30)], [1.0, 0.0]]))
    n = 10**13
    d = whitening.differences(x, n, [5, -7])
    assert d.dtype == object and d[0, 0] == n * int(x[0, 0]) - 5
    assert whitening.deviations(d[:, :1] * 0 + 10**18)[0].as_py() == 10**36
    assert whitening.deviations(np.array([[10**20]], dtype=object))[0].as_py() is None


def test_moments_merge():
    z = np.random.default_rng(0).normal(size=(50, 3)) + 100
    parts = [(float(len(p)), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in (z[:7], z[7:30], z[30:])]
    n, mean, s = whitening.merged(whitening.merged((0.0, np.zeros(3), np.zeros((3, 3))), parts[0]), whitening.merged(parts[1], parts[2]))
    assert n == 50 and np.allclose(mean, z.mean(axis=0)) and np.allclose(s / n, np.cov(z.T, bias=True))


def brute(rows, k=20, every=20):
    """{query id: [(vec_id, score)]} over usable rows, each alike row once."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = [(float((np.array(v) * np.array(w)).sum()), j) for j, w in rows if j != i and len(w) == len(v)]
            out.setdefault(i, []).append(sorted(near, key=lambda x: (-x[0], x[1]))[:k])
    return out


def lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_chi_square_quantile():
    z = np.random.default_rng(1).normal(size=(200_000, 12))
    assert abs(((z * z).sum(axis=1) < stable_search.chi_square_quantile(0.98, 12)).mean() - 0.98) < 2e-3


def test_op11_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = lists(q.op11_stable_search(spark, SF).collect())
    want = brute(rows)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    x = {i: np.array(v, float) for i, v in rows}
    for i, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[0], f[1]))
        assert all(math.isclose(s, x[i] @ x[j], rel_tol=1e-12, abs_tol=1e-15) and i != j for s, j in found)
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i][0]}) for i in want) / (20 * len(want)) > 0.95


def test_search_with_many_pages(spark):
    """Lengths that differ widely, copies, and an index of several cells and pages."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) * rng.choice([0.1, 1.0, 3.0], size=(1500, 1))
    long = int(np.linalg.norm(x, axis=1).argmax())  # its copies are nearest to each other
    rows = [(k, x[k].tolist()) for k in range(1500)] + [(2000 + k, x[long].tolist()) for k in range(400)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = lists(stable_search.nearest(frame_, page=100).collect())
    assert got.keys() == want.keys()
    share = sum(len({j for _, j in got[i]} & {j for _, j in want[i][0]}) for i in want) / (20 * len(want))
    assert share > 0.95
    assert got[2000][0][1] == long and [j for _, j in got[2000]] == [j for _, j in want[2000][0]]
    sure = lists(stable_search.nearest(frame_, page=100, confidence=1 - 1e-12).collect())
    assert {i: [j for _, j in v] for i, v in sure.items()} == {i: [j for _, j in v[0]] for i, v in want.items()}


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [2.0, 0.5]), (20, [2.0, 0.5]), (3, [2.0, 0.5]), (None, [9.0, 9.0]), (40, None), (60, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (80, [0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (5, [-1.0, -0.0]), (6, [-1.0, 0.0])]
    got = lists(stable_search.nearest(frame(spark, rows)).collect())
    assert got == {i: v[0] for i, v in brute(rows).items() if v[0]}
    assert got[0] == [(2.0, 3), (2.0, 20), (-1.0, 5), (-1.0, 6)]
    assert stable_search.nearest(frame(spark, rows).limit(0)).count() == 0
    assert stable_search.nearest(frame(spark, rows[:1])).count() == 0
    assert stable_search.nearest(frame(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
