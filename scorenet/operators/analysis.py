"""Analyses of scored networks: modules, hubs, trees, paths, classes and sets of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph, symmetric
from scorenet.operators.components import connected_components
from scorenet.operators.ranking import numbered
from scorenet.operators.trees import SMALL, Gain, subtree_values
from scorenet.storage import written


def module_score(g: ScoredGraph, ids: DataFrame) -> DataFrame:
    """(score, n_nodes) of the module of nodes ``ids`` (id), one row; each node counts once."""
    own = g.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return own.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("n_nodes"))


def negative_hub_benefit(g: ScoredGraph) -> DataFrame:
    """(id, benefit, beneficial) of negative nodes with a neighbour that is not: their score and those
    neighbours' together, and whether that is no less than the best of these alone."""
    near = g.nodes.where("score >= 0").select(F.col("id").alias("nbr"), F.col("score").alias("m"))
    hub = g.nodes.where("score < 0").select("id", "score").join(symmetric(g.edges), "id").join(near, "nbr").groupBy("id", "score").agg(F.sum("m").alias("s"), F.max("m").alias("top"))
    return hub.select("id", (F.col("score") + F.col("s")).alias("benefit"), (F.col("score") + F.col("s") >= F.col("top")).alias("beneficial"))


def hub_sample(hubs: DataFrame, share: int = 10, seed: int = 0) -> DataFrame:
    """(id) of a tenth of the hubs (id, benefit), one at least, drawn without replacement with chances by
    their rounded benefit, as turns of a roulette wheel; hubs whose benefit rounds to zero have none.
    Draws are keyed by seed and id."""
    live = hubs.withColumn("w", F.round("benefit")).where("w > 0")
    unit = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    turns = numbered(live.select("id", (-F.log(unit) / F.col("w")).alias("turn")), "turn", "id")
    n = turns.agg(F.max("k")).first()[0] or 0
    return turns.where(F.col("k") <= max(1, n // share)).select("id")


def edge_counters(edges: DataFrame) -> DataFrame:
    """(n_rows, n_self_loops, n_repeats, n_edges) of raw edges (u, v), one row: repeats are rows beyond
    the first of an undirected pair."""
    pairs = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    loop = F.col("u") == F.col("v")
    nil = F.lit(0)
    return pairs.agg(
        F.coalesce(F.sum("n"), nil).alias("n_rows"), F.coalesce(F.sum(F.when(loop, F.col("n"))), nil).alias("n_self_loops"),
        F.coalesce(F.sum(F.when(~loop, F.col("n") - 1)), nil).alias("n_repeats"), F.count_if(~loop).alias("n_edges"),
    )


def by_weight(g: ScoredGraph, ids: DataFrame | None = None) -> DataFrame:
    """(id, label, score) in descending order of score, ties by id."""
    nodes = g.nodes if ids is None else g.nodes.join(ids.select("id"), "id", "left_semi")
    return nodes.select("id", "label", "score").orderBy(F.desc("score"), "id")


def tree_values(tree: DataFrame, small: int = SMALL) -> DataFrame:
    """``tree`` (id, parent, score), rooted trees with null parents at the roots, and ``value``: the best
    connected set that holds the node and else only nodes below it, by contraction of the trees in rounds
    that grow with the logarithm of their nodes. A node that no root reaches is an error."""
    rows = written(tree.select("id", "parent", "score"), "tree")
    best = subtree_values(rows.withColumnRenamed("score", "value"), ["value"], Gain, small)
    return rows.join(best, "id").select("id", "parent", "score", "value")


def block_negativity(g: ScoredGraph, blocks: DataFrame) -> DataFrame:
    """(comp, block, negative): whether all nodes of a block (comp, block, u, v) are not positive."""
    ends = blocks.select("comp", "block", F.col("u").alias("id")).union(blocks.select("comp", "block", "v"))
    return ends.join(g.nodes.select("id", "score"), "id").groupBy("comp", "block").agg(F.bool_and(F.col("score") <= 0).alias("negative"))


def adjacent_pairs(g: ScoredGraph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``adjacent``: whether an edge joins them, in either order."""
    known = g.edges.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.lit(True).alias("_e"))
    out = pairs.join(known, (F.least("a", "b") == F.col("_u")) & (F.greatest("a", "b") == F.col("_v")), "left")
    return out.select(*pairs.columns, F.coalesce("_e", F.lit(False)).alias("adjacent"))


def paths_ok(paths: DataFrame, g: ScoredGraph) -> DataFrame:
    """``paths`` (path_id, step, id) as (path_id, ok): whether the scores added along a path reach their
    greatest sum at its end, and that is not negative. Nodes that the network lacks make it false. The
    steps of one path meet in one task."""
    rows = paths.join(g.nodes.select("id", "score"), "id", "left")
    steps = F.array_sort(F.collect_list(F.struct("step", "score")))
    sums = rows.groupBy("path_id").agg(steps.alias("s"), F.bool_and(F.col("score").isNotNull()).alias("known"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("top"))

    def add(acc, x):
        now = acc["sum"] + F.coalesce(x["score"], F.lit(0.0))
        return F.struct(now.alias("sum"), F.greatest(acc["top"], now).alias("top"))

    end = F.aggregate("s", start, add)
    return sums.select("path_id", (F.col("known") & (end["sum"] >= end["top"]) & (end["sum"] >= 0)).alias("ok"))


def equivalence_classes(pairs: DataFrame) -> DataFrame:
    """(id, class) from dependent pairs (a, b): nodes that depend on each other are one class, named by
    its least member; chains of such pairs join. Nodes without a mutual pair have no row."""
    mutual = pairs.select("a", "b").intersect(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a < b")
    return connected_components(mutual.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("comp", "class")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (id) in either set."""
    return a.select("id").union(b.select("id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (id) in both sets."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (id) of the first set that are not in the second."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def random_graph(spark: SparkSession, n: int, m: float, seed: int = 0) -> ScoredGraph:
    """n nodes of scores from -20 to 20, and about m edges: each pair of nodes has one with the same
    chance. Draws are keyed by seed and node, or pair. Pairs are numbered and drawn from as a sample of
    that range, so none but the edges are made."""
    score = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(41)) - 20
    nodes = spark.range(1, n + 1).select("id", score.cast("double").alias("score"))
    total = n * (n - 1) // 2
    picked = spark.range(total).sample(min(1.0, m / total), seed).select("id") if total else spark.range(0)
    # Pair number k is (u, v), u < v, where v - 1 is the triangular root of k.
    root = F.floor((F.sqrt(8 * F.col("id").cast("double") + 1) + 1) / 2)
    root = root - (root * (root - 1) / 2 > F.col("id")).cast("long")
    root = root + ((root + 1) * root / 2 <= F.col("id")).cast("long")
    edges = picked.select((F.col("id") - (root * (root - 1) / 2).cast("long") + 1).alias("u"), (root + 1).alias("v"))
    return ScoredGraph.of(nodes, edges)
