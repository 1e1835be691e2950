"""Reduction rules that keep the optimum, applied in bulk to the tables of a network.

Each rule takes a network and gives (reduced network, whether it changed). Roots are never removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph, symmetric
from scorenet.operators.components import connected_components
from scorenet.operators.parts import WHOLE, in_parts, streamed
from scorenet.operators.paths import least_costs
from scorenet.operators.ranking import numbered
from scorenet.plans.part_rules import SETTLED, settled
from scorenet.storage import written

Rule = Callable[[ScoredGraph], tuple[ScoredGraph, bool]]


def node_degrees(g: ScoredGraph) -> DataFrame:
    """(id, score, is_root, degree)."""
    d = symmetric(g.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.select("id", "score", "is_root").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def neg_deg01(g: ScoredGraph) -> DataFrame:
    """Negative nodes of degree 0 or 1."""
    return node_degrees(g).where("score < 0 and degree <= 1 and not is_root").select("id")


def _contraction(edges: DataFrame) -> DataFrame:
    return connected_components(edges).where("id <> comp").select(F.col("id").alias("old"), F.col("comp").alias("new"))


def _ends(g: ScoredGraph) -> DataFrame:
    n = node_degrees(g)
    a = n.select(F.col("id").alias("u"), F.col("score").alias("su"), F.col("is_root").alias("ru"), F.col("degree").alias("du"))
    b = n.select(F.col("id").alias("v"), F.col("score").alias("sv"), F.col("is_root").alias("rv"), F.col("degree").alias("dv"))
    return g.edges.join(a, "u").join(b, "v")


def pos_edges(g: ScoredGraph) -> DataFrame:
    """Edges between two non-negative nodes that are no roots; their components contract."""
    return _ends(g).where("su >= 0 and sv >= 0 and not ru and not rv").select("u", "v")


def neg_chain_edges(g: ScoredGraph) -> DataFrame:
    """Edges between two non-positive nodes of degree 2 that are no roots; the chains contract."""
    return _ends(g).where("su <= 0 and sv <= 0 and du = 2 and dv = 2 and not ru and not rv").select("u", "v")


def pos_leaves(g: ScoredGraph) -> DataFrame:
    """(id, nbr, score) of non-negative leaves; each merges into its neighbour."""
    leaf = node_degrees(g).where("score >= 0 and degree = 1 and not is_root")
    return leaf.join(symmetric(g.edges), "id").select("id", "nbr", "score")


def degree2(g: ScoredGraph) -> DataFrame:
    """(id, score, is_root, a, b) of nodes with just two neighbours a < b."""
    pair = symmetric(g.edges).groupBy("id").agg(F.min("nbr").alias("a"), F.max("nbr").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    return pair.join(g.nodes.select("id", "score", "is_root"), "id")


def neg_circuit(g: ScoredGraph) -> DataFrame:
    """Non-positive nodes of degree 2 whose neighbours are adjacent."""
    return degree2(g).where("score <= 0 and not is_root").join(g.edges.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_semi").select("id")


def _standing():
    """What the node that stays among alike ones is greatest in: roots, then scores, then lower ids."""
    return F.struct(F.col("is_root").cast("int").alias("r"), "score", (-F.col("id")).alias("i"))


def neg_diamond(g: ScoredGraph) -> DataFrame:
    """Of non-positive nodes of degree 2 with the same neighbours all but the best, and that too if a
    positive node of degree 2 joins the same neighbours."""
    d = degree2(g)
    low = F.col("score") <= 0
    pairs = d.groupBy("a", "b").agg(F.max(F.when(low, _standing())).alias("best"), F.bool_or(~low).alias("bridged"))
    return d.where(low & ~F.col("is_root")).join(pairs, ["a", "b"]).where("bridged or id <> -best.i").select("id")


def mirrored_hubs(g: ScoredGraph, least_degree: int = 3) -> DataFrame:
    """Of non-positive nodes with the same neighbours, at least three, all but the best; ties keep the
    lower id. Candidates agree in size, extremes and hash sums of their neighbour sets, which are
    aggregated before the shuffle, so no set is ever collected, nor do alike nodes meet; the neighbours of
    each are then held against those of the one that stays."""
    arcs = symmetric(g.edges)
    h1, h2 = F.xxhash64("nbr"), F.xxhash64("nbr", F.lit(1))
    sets = arcs.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min("nbr").alias("lo"), F.max("nbr").alias("hi"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2"))
    low = sets.where(F.col("degree") >= least_degree).join(g.nodes.select("id", "score", "is_root"), "id").where("score <= 0")
    low = written(low, "neighbour_sets")
    same = ["degree", "lo", "hi", "x1", "x2"]
    stays = low.groupBy(*same).agg(F.max(_standing()).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, (-F.col("best.i")).alias("stays"))
    alike = low.where("not is_root").join(stays, same).where("id <> stays").select("id", "degree", "stays")
    both = alike.join(arcs, "id").join(arcs.select(F.col("id").alias("stays"), "nbr"), ["stays", "nbr"], "left_semi")
    return both.groupBy("id", "degree").agg(F.count(F.lit(1)).alias("c")).where("c = degree").select("id")


def dominated_hubs(g: ScoredGraph) -> DataFrame:
    """Non-positive u for which some v has a greater score and all of u's neighbours. Such a v is a
    neighbour of each of them, so it is looked for at the one of least degree alone; then all of u's
    neighbours are held against v's."""
    n = written(node_degrees(g), "degrees")
    arcs = written(symmetric(g.edges), "arcs")
    low = n.where("score <= 0 and degree > 0 and not is_root").select(F.col("id").alias("u"), F.col("score").alias("su"), F.col("degree").alias("du"))
    at = arcs.select(F.col("id").alias("u"), F.col("nbr").alias("x")).join(n.select(F.col("id").alias("x"), F.col("degree").alias("dx")), "x")
    pivot = low.join(at, "u").groupBy("u", "su", "du").agg(F.min(F.struct("dx", "x")).alias("p")).select("u", "su", "du", F.col("p.x").alias("x"))
    better = n.select(F.col("id").alias("v"), F.col("score").alias("sv"), F.col("degree").alias("dv"))
    pairs = pivot.join(arcs.select(F.col("id").alias("x"), F.col("nbr").alias("v")), "x").where("u <> v").join(better, "v").where("sv > su and dv >= du").select("u", "v", "du")
    near = pairs.join(arcs.select(F.col("id").alias("u"), F.col("nbr").alias("y")), "u").join(arcs.select(F.col("id").alias("v"), F.col("nbr").alias("y")), ["v", "y"], "left_semi")
    return near.groupBy("u", "v", "du").agg(F.count(F.lit(1)).alias("c")).where("c = du").select(F.col("u").alias("id")).distinct()


def pos_diamond(g: ScoredGraph) -> DataFrame:
    """Of two non-positive nodes whose neighbourhoods are the same set of non-negative nodes of degree
    2, the worse one, the first if equal; the other if that is a root."""
    d = degree2(g).where("score >= 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = node_degrees(g)
    a = n.select(F.col("id").alias("a"), F.col("score").alias("sa"), F.col("is_root").alias("ra"), F.col("degree").alias("da"))
    b = n.select(F.col("id").alias("b"), F.col("score").alias("sb"), F.col("is_root").alias("rb"), F.col("degree").alias("db"))
    both = d.join(a, "a").join(b, "b").where("sa <= 0 and sb <= 0 and da = c and db = c")
    first = (F.col("sa") <= F.col("sb")) & ~F.col("ra")
    pick = F.when(first, F.col("a")).when((F.col("sb") <= F.col("sa")) & ~F.col("rb"), F.col("b"))
    return both.select(pick.alias("id")).where("id is not null").distinct()


def _by_pairs(pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of ``shortest_path`` among ``pairs`` (id, score, is_root, a, b) without a detour by an edge
    from a to b or over one other node of ``pairs``, and the ids of those that have one."""
    low = (F.col("score") <= 0) & ~F.col("is_root")
    best = pairs.groupBy("a", "b").agg(F.max(F.when(low, F.struct("score", "id"))).alias("top"), F.max(F.when(~low, F.least("score", F.lit(0.0)))).alias("free"))
    direct = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("direct"))
    marked = pairs.where(low).join(best, ["a", "b"]).join(direct, ["a", "b"], "left")
    short = F.coalesce("direct", F.lit(False)) | (F.col("top.id") != F.col("id")) | F.coalesce(F.col("free") >= F.col("score"), F.lit(False))
    marked = written(marked.withColumn("short", short), "paired")
    return marked.where("not short").select("id", "score", "a", "b"), marked.where("short").select("id")


def shortest_path(g: ScoredGraph, width: float | None = None) -> DataFrame:
    """Non-positive nodes of degree 2 with a detour between their neighbours, of any length, that costs no
    more. A detour may use no other candidate that is not greater in the order of (score, id), so all such
    nodes can go at once. The searches of all candidates run side by side, each from the neighbour with
    fewer neighbours, within what the candidate costs, and end when they reach the other. Detours by an edge
    or one node of degree 2 are found first, by the pair of neighbours; those candidates are not searched."""
    degree = written(node_degrees(g), "degrees")
    pairs = written(degree2(g), "pairs")
    cand, plain = _by_pairs(pairs, g.edges)
    every = pairs.where("score <= 0 and not is_root").select("id", F.lit(True).alias("is_cand"))
    ends = [degree.select(F.col("id").alias(c), F.col("degree").alias(f"d{c}")) for c in "ab"]
    cand = cand.join(ends[0], "a").join(ends[1], "b").select(F.col("id").alias("key"), F.col("score").alias("sc"), F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("goal"))
    cand = written(cand, "candidates")
    costs = g.nodes.join(every, "id", "left")
    costs = costs.select("id", F.greatest(-F.col("score"), F.lit(0.0)).alias("cost"), F.col("score").alias("sx"), "is_cand")
    at_goal = F.col("id") == F.col("goal")
    free = F.col("is_cand").isNull() | (F.col("sx") > F.col("sc")) | ((F.col("sx") == F.col("sc")) & (F.col("id") > F.col("key")))
    allowed = (F.col("id") != F.col("key")) & (F.col("dist") <= -F.col("sc")) & (at_goal | free)
    start = cand.select("key", "id", F.lit(0.0).alias("dist"), "sc", "goal")
    found = least_costs(symmetric(g.edges), costs, start, ("sc", "goal"), F.when(at_goal, 0.0).otherwise(F.col("cost")), allowed, at_goal, width)
    return plain.unionByName(found.where(at_goal).select(F.col("key").alias("id")))


def removing(find: Callable[[ScoredGraph], DataFrame]) -> Rule:
    def rule(g: ScoredGraph) -> tuple[ScoredGraph, bool]:
        ids = written(find(g), "gone")
        if ids.isEmpty():
            return g, False
        return g.without(ids).stored(), True

    rule.__name__ = find.__name__
    return rule


def contracting(find: Callable[[ScoredGraph], DataFrame]) -> Rule:
    def rule(g: ScoredGraph) -> tuple[ScoredGraph, bool]:
        merge = written(_contraction(find(g)), "merge")
        if merge.isEmpty():
            return g, False
        return g.merged(merge).stored(), True

    rule.__name__ = find.__name__
    return rule


def pos_deg01(g: ScoredGraph) -> tuple[ScoredGraph, bool]:
    """Isolated nodes below the lower bound go. A non-negative leaf merges into its neighbour; without
    roots, one that reaches the lower bound first leaves an isolated copy of itself."""
    bound, rooted, top = g.nodes.agg(F.greatest(F.max("score"), F.lit(0.0)), F.bool_or("is_root"), F.max("id")).first()
    if bound is None:
        return g, False
    gone = written(node_degrees(g).where((F.col("score") >= 0) & (F.col("score") < bound) & (F.col("degree") == 0) & ~F.col("is_root")).select("id"), "gone")
    leaves = pos_leaves(g)
    taken = leaves.select(F.col("id").alias("nbr"), F.lit(True).alias("_l"))
    leaves = leaves.join(taken, "nbr", "left").where("_l is null or id > nbr").drop("_l")  # of two joined leaves the later goes
    leaves = written(leaves, "leaves")
    changed = False
    if not gone.isEmpty():
        g, changed = g.without(gone), True
    if not leaves.isEmpty():
        if not rooted:
            copies = numbered(leaves.where(F.col("score") >= bound).select("id"), "id")
            g = g.extracted(written(copies.select((F.col("k") + top).alias("set_id"), "id"), "copies"))
        g, changed = g.merged(leaves.select(F.col("id").alias("old"), F.col("nbr").alias("new"))), True
    return (g.stored() if changed else g), changed


#: Rules by phase; any change starts again at the first.
PHASES: list[list[Rule]] = [
    [removing(neg_deg01), contracting(pos_edges), contracting(neg_chain_edges), pos_deg01],
    [removing(pos_diamond), removing(mirrored_hubs)],
    [removing(shortest_path)],
]
EXTRA_RULES: list[Rule] = [removing(neg_circuit), removing(neg_diamond), removing(dominated_hubs)]


def _small_parts(g: ScoredGraph, whole: int) -> tuple[ScoredGraph, bool]:
    """``g`` with the rules of ``PHASES`` settled in components of at most ``whole`` edges, which go whole to
    tasks, and whether there are larger ones. A leaf's copy stays if it reaches the lower bound at the end; as
    that never falls without roots, no other copy would outlast the rules on tables."""
    floor, rooted, top, odd = g.nodes.agg(F.greatest(F.max("score"), F.lit(0.0)), F.bool_or("is_root"), F.max("id"), F.count_if(F.col("score").isNull() | F.isnan("score"))).first()
    if floor is None or odd:
        return g, True
    edges, _, more = in_parts(g.edges, whole)
    ends = edges.select("comp", F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.min("comp").alias("comp"))
    nodes = g.nodes.join(ends, "id").select("comp", F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), "score", "is_root")
    rows = nodes.unionByName(edges.select("comp", "u", "v"), allowMissingColumns=True)
    got = written(streamed(rows, lambda t: settled(t, floor, rooted), SETTLED), "settled")
    moved, copies = got.where("not copy"), got.where("copy")
    out = g.without(moved.where("new is null").select(F.col("old").alias("id"))).merged(moved.where("new is not null").select("old", "new")).stored()
    bound = out.nodes.select("score").unionByName(copies.select("score")).agg(F.greatest(F.max("score"), F.lit(0.0))).first()[0]
    copies = written(copies.where(F.col("score") >= bound).select("old", F.col("new").alias("id")), "copies")
    if not copies.isEmpty():
        each = written(numbered(copies.select("old").distinct(), "old").select("old", (F.col("k") + top).alias("set_id")), "copied")
        fresh = g.extracted(copies.join(each, "old").select("set_id", "id"))
        labels = each.join(g.nodes.select(F.col("id").alias("old"), "label"), "old").select(F.col("set_id").alias("id"), "label")
        nodes = fresh.nodes.where(F.col("id") > top).drop("label").join(labels, "id").select(*g.nodes.columns)
        out = ScoredGraph(out.nodes.unionByName(nodes), out.edges, out.node_map.unionByName(fresh.node_map.where(F.col("pre_id") > top)))
    if not more:
        alone = node_degrees(out).where((F.col("degree") == 0) & (F.col("score") < (bound or 0.0)) & ~F.col("is_root"))
        out = out.without(written(alone.select("id"), "gone"))
    return out.stored(), more


def reduced(g: ScoredGraph, phases: list[list[Rule]] | None = None, most_rounds: int = 200, whole: int = WHOLE) -> ScoredGraph:
    """All phases to a fixpoint. With those of ``PHASES`` components of at most ``whole`` edges are settled in
    tasks first. Others are changed as tables; more than ``most_rounds`` rounds of these raise an error."""
    g = g.stored()
    if phases is None:
        g, more = _small_parts(g, whole)
        if not more:
            return g
    phases = PHASES if phases is None else phases
    k = 0
    for _ in range(most_rounds):
        if k == len(phases):
            return g
        changed = False
        for rule in phases[k]:
            g, c = rule(g)
            changed |= c
        k = 0 if changed else k + 1
    raise RuntimeError(f"reduction did not settle in {most_rounds} rounds")


def with_rule(phase: int, rule: Rule, phases: list[list[Rule]] | None = None) -> list[list[Rule]]:
    """Phases with ``rule`` added to phase number ``phase``, counted from 1."""
    out = [list(p) for p in (PHASES if phases is None else phases)]
    while len(out) < phase:
        out.append([])
    out[phase - 1].append(rule)
    return out
