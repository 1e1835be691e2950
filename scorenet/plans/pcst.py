"""Prize-collecting instances as scored networks, and their costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.storage import written


def pcst_graph(nodes: DataFrame, edges: DataFrame) -> ScoredGraph:
    """nodes (id, prize, perhaps is_root and label) and edges (u, v, cost) as a scored network: each edge
    becomes a node labelled "u--v" that weighs minus its cost, joined to both ends. Roots have no prize.
    Edge nodes have negative ids, which are drawn once and written."""
    mid = written(edges.select((-1 - F.monotonically_increasing_id()).alias("id"), "u", "v", "cost"), "pcst_edges")
    root = F.coalesce(F.col("is_root"), F.lit(False)) if "is_root" in nodes.columns else F.lit(False)
    label = F.col("label") if "label" in nodes.columns else F.col("id").cast("string")
    own = nodes.select("id", label.alias("label"), F.when(root, F.lit(0)).otherwise(F.col("prize")).cast("double").alias("score"), root.alias("is_root"))
    between = mid.select("id", F.format_string("%d--%d", "u", "v").alias("label"), (-F.col("cost")).cast("double").alias("score"), F.lit(False).alias("is_root"))
    return ScoredGraph.of(own.unionByName(between), mid.select(F.col("id").alias("u"), F.col("u").alias("v")).union(mid.select("id", "v")))


def cost(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cost), one row: costs of the edges taken (u, v, cost) and prizes of the nodes (id, prize) that
    are not chosen (id)."""
    own = edges.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("c"))
    rest = nodes.join(chosen.select("id").distinct(), "id", "left_anti").agg(F.coalesce(F.sum("prize"), F.lit(0)).alias("p"))
    return own.join(F.broadcast(rest)).select((F.col("c") + F.col("p")).alias("cost"))


def node_profit(g: ScoredGraph, ids: DataFrame) -> DataFrame:
    """(profit), one row: the sum of the scores of those nodes ``ids`` (id) that are nodes of the
    instance itself, whose labels are plain numbers; the others stand for edges."""
    own = g.nodes.where(F.regexp_like("label", F.lit("^[0-9]+$"))).join(ids.select("id").distinct(), "id", "left_semi")
    return own.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("profit"))
