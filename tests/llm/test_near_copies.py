"""The pipeline's near-dedup stage against all pairs."""

import random

import numpy as np
import pytest
from moved import moved

from scorenet.llm import near_copies, simhash_index


@pytest.mark.parametrize(("large", "order"), [(4_000, 40)])
def test_stage_all_pairs(spark, monkeypatch, large, order):
    monkeypatch.setattr(near_copies, "TASK_SHINGLES", large)
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", order)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 300]))] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(common + [f"z{rng.randrange(5000)}" for _ in range(rng.choice([5, 15, 60]))])) for i in range(60)]
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "ONE  two"), (None, rows[0][1])]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    low = {i: i for i in ids}
    near = [(i, j) for i in ids for j in ids if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        before = dict(low)
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.keep_id for r in near_copies.near_copies(docs, 5).collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.99 * len(near) > 0
    assert all(low[got[i]] == low[i] for i in ids)  # every link is one by the exact similarity
    assert got == low and len(set(low.values())) < len(ids)  # with these texts nothing at all is missed
    left = [r.doc_id for r in simhash_index.stage(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([None, *(i for i in ids if low[i] == i)], key=str)


def test_alike_is_exact():
    """Against plain set arithmetic, at the border and with all differences at either end."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 190, 400, 1000, 5000):
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for share in (0.0, 0.1, 0.11, 0.112, 0.2, 0.5, 1.0):
            k = round(share * len(base))
            for gone in (base[:k], base[len(base) - k :], rng.permutation(base)[:k]):
                other = np.unique(np.r_[np.setdiff1d(base, gone), rng.integers(0, 1 << 62, k).astype(np.uint64)])
                both, either = len(np.intersect1d(base, other)), len(np.union1d(base, other))
                assert near_copies.alike(base, other) == near_copies.alike(other, base) == (5 * both >= 4 * either)


def test_pipeline_runs_whole(spark):
    """The stages in their order over the smallest table, each held to its own input."""
    from collections import defaultdict

    import corpus_pipeline

    docs = before = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        rows = {r.doc_id: r.text for r in after.collect()}
        assert rows.items() <= {r.doc_id: r.text for r in before.collect()}.items()
        kept.append(rows)
        before = spark.createDataFrame(after.collect(), docs.schema)
    plain = lambda t: " ".join((t or "").split())
    assert len(set(map(plain, kept[1].values()))) == len(kept[1]) and set(map(plain, kept[0].values())) == set(map(plain, kept[1].values()))
    sets = {i: near_copies.shingle_hashes(t, 5) for i, t in kept[1].items()}
    low = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and near_copies.alike(sets[i], sets[j])]
    for _ in sets:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert kept[2].keys() == {i for i in sets if low[i] == i}
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect():
        pieces[r.doc_id] += r.length
    assert pieces.keys() == kept[2].keys()


def test_frequent_shingles_of_all_sets(spark, monkeypatch):
    """Every set counts, not those of a sample: a shingle that few of many sets share is found."""
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 50)
    sets = [[-5, 7, 1000 + i] if i in (3, 4, 900, 901, 902, 903) else [2000 + i, 4000 + i] for i in range(100)]
    nodes = spark.createDataFrame([(s,) for s in sets], "low array<long>").repartition(3)
    assert near_copies.frequent_shingles(nodes, 100).tolist() == []  # two of six in question are there
    sets = [[-5, 7, 1000 + i] if i % 17 == 0 else [2000 + i, 4000 + i] for i in range(100)]
    nodes = spark.createDataFrame([(s,) for s in sets], "low array<long>").repartition(3)
    assert near_copies.frequent_shingles(nodes, 100).tolist() == [7, (1 << 64) - 5]


def test_texts_that_stay_are_not_shuffled(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.randbytes(8).hex() for _ in range(500))) for i in range(300)]
    short = [" ".join(rng.randbytes(8).hex() for _ in range(60)) for _ in range(10)]
    rows += [(1000 + 100 * k + i, t + " end" * k) for k in range(2) for i, t in enumerate(short)]
    rows += [(None, short[0]), (1100, short[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, least = moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [r.doc_id for r in simhash_index.stage(spark, docs, "").select("doc_id", "text").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sorted(i for i in got if i is not None) == [*range(300), *range(1000, 1010)] and got.count(None) == 1
    assert moved(spark) - before < 1_800_000  # texts: 2,550,000 characters
