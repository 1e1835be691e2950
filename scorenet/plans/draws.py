"""Monte Carlo by spanning trees over whole networks. Small components go whole to a task, many to each, which
draws all their forests; of the large ones all draws are one forest, whose nodes are numbered by draw and node,
and whose best subtree is found by contraction."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.operators.analysis import negative_hub_benefit
from scorenet.operators.components import connected_components
from scorenet.operators.parts import WHOLE, in_parts, streamed
from scorenet.operators.ranking import numbered
from scorenet.operators.topology import forest_rows, spanning_forest
from scorenet.operators.trees import SMALL, Gain, rooted, subtree_values
from scorenet.storage import dropped, written

STRATEGIES = ("fixed", "random", "uniform_random", "min_max")
#: Draws whose trees are made at once.
TOGETHER = 8


def _chance(*of):
    """A number in [0, 1) keyed by the columns."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def sampled_hubs(g: ScoredGraph, draws: list[int], seed: int, share: int = 10) -> DataFrame:
    """(draw, id) of negative hubs that pay, drawn anew each time: a ``share``-th, one at least, by benefit
    without replacement, and as large a share of the others by chance."""
    hubs = negative_hub_benefit(g).where("beneficial").select("id", F.greatest(F.round("benefit"), F.lit(0.0)).alias("w"))
    hubs = hubs.select(F.explode(F.array(*map(F.lit, draws))).alias("draw"), "id", "w")
    turn = F.when(F.col("w") > 0, -F.log(_chance("draw", "id", F.lit(seed), F.lit("hub")) + 2.0**-54) / F.col("w")).otherwise(float("inf"))
    hubs = written(numbered(hubs.withColumn("turn", turn), "draw", "turn", "id"), "hubs")
    first = hubs.groupBy("draw").agg(F.min("k").alias("_k"), F.count(F.lit(1)).alias("n"))
    picked = ((F.col("k") - F.col("_k") < F.greatest(F.lit(1), F.floor(F.col("n") / share))) & (F.col("w") > 0)) | (_chance("draw", "id", F.lit(seed), F.lit("more")) < 1 / share)
    return hubs.join(first, "draw").where(picked).select("draw", "id")


def drawn_costs(g: ScoredGraph, draws: list[int], strategy: str = "random", seed: int = 0, hubs: bool = False) -> DataFrame:
    """(draw, u, v, cost) of every edge: fixed -(w_u + w_v); random 2 - (r_u + r_v); uniform_random the same
    with r up to the node's scaled score; min_max 2 - the scaled scores. r is keyed by seed, draw and node.
    ``hubs`` makes the edges between sampled negative hubs and nodes that are not negative nearly free."""
    return _drawn(_scored_edges(g, g.edges), g, draws, strategy, seed, hubs).select("draw", "u", "v", "cost")


def _scored_edges(g: ScoredGraph, edges: DataFrame) -> DataFrame:
    """``edges`` with the scores (wu, wv) and scaled scores (su, sv) of their ends."""
    ends = g.nodes.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    of = g.nodes.join(F.broadcast(ends)).select("id", "score", "is_root", scaled.alias("s"))  # one row
    for c in "uv":
        edges = edges.join(of.select(F.col("id").alias(c), F.col("score").alias(f"w{c}"), F.col("s").alias(f"s{c}"), F.col("is_root").alias(f"r{c}")), c)
    return edges


def _drawn(rows: DataFrame, g: ScoredGraph, draws: list[int], strategy: str, seed: int, hubs: bool) -> DataFrame:
    """Rows of ``_scored_edges`` once for each draw, with ``draw`` and ``cost``; without hubs in their order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    rows = rows.withColumn("draw", F.explode(F.array(*map(F.lit, draws))))
    r = {c: _chance("draw", c, F.lit(seed)) for c in "uv"}
    cost = {
        "fixed": -(F.col("wu") + F.col("wv")), "min_max": 2 - (F.col("su") + F.col("sv")),
        "random": 2 - (r["u"] + r["v"]), "uniform_random": 2 - (r["u"] * F.col("su") + r["v"] * F.col("sv")),
    }[strategy]
    rows = rows.withColumn("cost", cost)
    if hubs:
        picked = written(sampled_hubs(g, draws, seed), "picked_hubs")
        for c in "uv":
            rows = rows.join(picked.select("draw", F.col("id").alias(c), F.lit(True).alias(f"h{c}")), ["draw", c], "left")
        free = (F.col("hu") & (F.col("wv") >= 0)) | (F.col("hv") & (F.col("wu") >= 0))
        rows = rows.withColumn("cost", F.when(free, _chance("draw", "u", "v", F.lit(seed)) * 1e-3).otherwise(F.col("cost")))
    return rows.withColumn("cost", F.col("cost").cast("double"))


def tree_sums(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1 at roots) in the trees of edges (a, b) between nodes 0 to n - 1, and the best sum of a
    connected set that holds the node and else only nodes below it; level by level, all trees at once."""
    order = np.argsort(np.r_[a, b], kind="stable")
    to, start = np.r_[b, a][order], np.searchsorted(np.r_[a, b][order], np.arange(n + 1))
    parent, levels = np.full(n, -1), [roots]
    while len(levels[-1]):
        front = levels[-1]
        size = start[front + 1] - start[front]
        at = np.repeat(start[front] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        near, above = to[at], np.repeat(front, size)
        down = near != parent[above]
        parent[near[down]] = above[down]
        levels.append(near[down])
    value = score.copy()
    for level in reversed(levels[1:]):
        np.add.at(value, parent[level], np.maximum(value[level], 0.0))
    return parent, value


def _trees(rows: pa.Table):
    """For each draw of whole components (comp, draw, u, v, xu, xv, cost): (draw, ids of the nodes, parents,
    values) of their minimum forests, rooted at the least nodes."""
    rows = rows.sort_by([("draw", "ascending"), ("cost", "ascending"), ("u", "ascending"), ("v", "ascending")])
    draw, u, v = (rows.column(c).to_numpy() for c in ("draw", "u", "v"))
    for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, draw[1:] != draw[:-1]]), [*cuts[1:], len(draw)], strict=True):
        ids, first, at = np.unique(np.r_[u[lo:hi], v[lo:hi]], return_index=True, return_inverse=True)
        a, b = at[: hi - lo], at[hi - lo :]
        comp = np.tile(rows.column("comp").to_numpy()[lo:hi], 2)[first]
        score = np.r_[rows.column("xu").to_numpy()[lo:hi], rows.column("xv").to_numpy()[lo:hi]][first]
        keep = forest_rows(a, b, len(ids))
        yield int(draw[lo]), ids, *tree_sums(len(ids), a[keep], b[keep], np.flatnonzero(ids == comp), score)


def _tops(rows: pa.Table) -> pa.Table:
    out = []
    for draw, ids, _, value in _trees(rows):
        k = int(np.argmax(value))  # the first of equals has the least id
        out.append((draw, int(ids[k]), float(value[k])))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["draw", "id", "value"])


def _below(top: int):
    def run(rows: pa.Table) -> pa.Table:
        got = []
        for _, ids, parent, value in _trees(rows):
            held = ids == top
            while True:
                more = held | ((parent >= 0) & held[parent] & (value > 0))
                if (more == held).all():
                    break
                held = more
            got += ids[held].tolist()
        return pa.table([pa.array(got, pa.int64())], names=["id"])

    return run


class _Parts:
    """Draws over the small components of a network."""

    def __init__(self, g: ScoredGraph, few: DataFrame, score, draw_args: tuple):
        self.g, self.score, self.args = g, score, draw_args
        self.edges = written(_scored_edges(g, few), "scored_edges")

    def rows(self, edges: DataFrame, draws: list[int]) -> DataFrame:
        hubs = self.args[-1]
        if not hubs:
            edges = edges.repartition("comp").sortWithinPartitions("comp")
        rows = _drawn(edges, self.g, draws, *self.args)
        if hubs:
            rows = rows.repartition("comp").sortWithinPartitions("comp")
        return rows.select("comp", F.col("draw").cast("long").alias("draw"), "u", "v", self.score("u").cast("double").alias("xu"), self.score("v").cast("double").alias("xv"), "cost")

    def top(self, draws: list[int]):
        """(value, draw, id) of the best subtree's top, nulls if there is none."""
        tops = streamed(self.rows(self.edges, draws), _tops, "draw long, id long, value double", dealt=True)
        best = F.struct("value", -F.col("draw"), -F.col("id"))
        return tops.agg(F.max("value"), F.max_by("draw", best), F.max_by("id", best)).first()

    def ids(self, draw: int, top: int) -> DataFrame:
        comp = self.edges.where((F.col("u") == top) | (F.col("v") == top)).select("comp").limit(1)
        own = self.edges.join(F.broadcast(comp), "comp", "left_semi")  # one component
        return written(streamed(self.rows(own, [draw]), _below(top), "id long", dealt=True), "drawn")


def best_subtree(nodes: DataFrame, forest: DataFrame, small: int = SMALL) -> tuple[float | None, DataFrame | None, int | None]:
    """The greatest sum of a connected set of a forest (u, v) over nodes (id, score), its nodes (id) and its
    top; None of each if there is no node. Ties go to the least top of a tree rooted at its least node."""
    tree = rooted(forest, small)
    rows = written(nodes.select("id", F.col("score").alias("value")).join(tree, "id", "left"), "forest_nodes")
    value = subtree_values(rows.select("id", "parent", "value"), ["value"], Gain, small)
    top = value.agg(F.max_by("id", F.struct("value", -F.col("id"))).alias("id"), F.max("value").alias("value")).first()
    if top.id is None:
        return None, None, None
    at = rows.where(F.col("id") == top.id).select("root", "first", "last").first()
    ids = nodes.sparkSession.createDataFrame([(top.id,)], "id long")
    if at.root is not None:
        below = rows.where((F.col("root") == at.root) & F.col("first").between(at["first"], at["last"]) & (F.col("id") != top.id))
        held = connected_components(below.join(value.where("value > 0").select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("parent").alias("v")))
        held = written(held, "held")
        mine = held.where(F.col("id") == top.id).select("comp")
        ids = ids.union(held.join(mine, "comp", "left_semi").select("id")).distinct()
    ids = written(ids, "best_subtree")
    dropped(rows, value)
    return top.value, ids, top.id


def best_of_draws(g: ScoredGraph, draws: int = 20, strategy: str = "random", seconds: float | None = None, hubs: bool = False, seed: int = 0, small: int = SMALL, whole: int | None = None) -> tuple[float, DataFrame]:
    """(score, nodes (id)) of the best connected set of any of ``draws`` spanning forests, or as many as
    take ``seconds``, a first few at least; nothing with score 0 if no node is positive. Roots are all in
    it, if one tree holds them all: they weigh more than all other nodes together while it is looked for.
    Ties go to the first draw, then to the least top of a tree rooted at its least node. Components of at
    most ``whole`` edges, no more than ``small``, are drawn in tasks, the others as tables."""
    began = time.monotonic()
    if strategy in ("fixed", "min_max") and not hubs:
        draws = 1
    roots, total = g.nodes.agg(F.count_if("is_root"), F.sum(F.abs("score"))).first()
    heavy = 1.0 + (total or 0.0)

    def score(of: str = ""):
        own, root = (F.col(f"w{of}"), F.col(f"r{of}")) if of else (F.col("score"), F.col("is_root"))
        return own + F.when(root, heavy).otherwise(0.0) if roots else own

    few, many, has_many = in_parts(g.edges, min(WHOLE, small) if whole is None else whole)
    parts = _Parts(g, few, score, (strategy, seed, hubs))
    joined = g.edges.select(F.explode(F.array("u", "v")).alias("id"))
    alone = g.nodes.join(joined, "id", "left_anti").agg(F.max(score()), F.max_by("id", F.struct(score(), -F.col("id")))).first()
    nodes = n = None
    if has_many:
        far = many.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        nodes = written(numbered(g.nodes.join(far, "id", "left_semi").select("id", score().alias("score")), "id"), "numbered_nodes")
        n = nodes.count()
        many = written(_scored_edges(g, many), "scored_edges")
    none = g.nodes.select("id").limit(0)
    best, found = (float("-inf"), none) if roots else (0.0, none)
    for lo in range(0, draws, TOGETHER):
        if lo and seconds and time.monotonic() - began > seconds:
            break
        some = list(range(lo, min(draws, lo + TOGETHER)))
        got = []
        if not lo and alone[1] is not None:
            got.append((alone[0], 0, -alone[1], lambda: g.spark.createDataFrame([(alone[1],)], "id long")))
        value, draw, top = parts.top(some)
        if value is not None:
            got.append((value, -draw, -top, lambda draw=draw, top=top: parts.ids(draw, top)))
        if has_many:
            edges = _drawn(many, g, some, strategy, seed, hubs).select("draw", "u", "v", "cost")
            for c in "uv":
                edges = edges.join(nodes.select(F.col("id").alias(c), F.col("k").alias(f"k{c}")), c)
            at = F.col("draw").cast("long") * n
            forest = written(spanning_forest(edges.select((at + F.col("ku")).alias("u"), (at + F.col("kv")).alias("v"), "cost"), small=small).select("u", "v"), "drawn_forest")
            copies = nodes.withColumn("draw", F.explode(F.array(*map(F.lit, some)))).select((at + F.col("k")).alias("id"), "score")
            value, ids, top = best_subtree(copies, forest, small)
            dropped(forest)
            if value is not None:
                draw, k = divmod(top - 1, n)
                got.append((value, -draw, -nodes.where(F.col("k") == k + 1).first().id, lambda ids=ids: written(nodes.join(ids.select((F.pmod(F.col("id") - 1, F.lit(n)) + 1).alias("k")), "k", "left_semi").select("id"), "drawn")))
        value, _, _, ids = max(got, key=lambda x: x[:3], default=(float("-inf"), 0, 0, None))
        if value > best:
            best, found = value, ids()
    if roots and found.join(g.nodes.where("is_root"), "id", "left_semi").count() < roots:
        return float("-inf"), found.limit(0)
    total = g.nodes.join(found, "id", "left_semi").agg(F.sum("score")).first()[0]
    return (total or 0.0), found
