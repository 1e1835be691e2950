"""Shortest paths whose cost lies on the nodes, from many sources at once, as tables.

A label (key, id) holds the least cost known of reaching a node in the search of that name. Rounds take the
labels that are new and lie in the nearest bucket of costs, hand them over the arcs, and keep the least for
each node; a bucket is left when it has no new label (delta-stepping). Searches of many keys share rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph, symmetric
from scorenet.storage import dropped, written


def entry_costs(g: ScoredGraph) -> DataFrame:
    """(id, cost): what a path pays for a node, nothing for one that is not negative."""
    return g.nodes.select("id", F.greatest(-F.col("score"), F.lit(0.0)).alias("cost"))


def least_costs(arcs: DataFrame, costs: DataFrame, sources: DataFrame, carry: tuple[str, ...] = (), price: Column | None = None, allowed: Column | None = None, done: Column | None = None, width: float | None = None, most_rounds: int = 100_000) -> DataFrame:
    """(key, id, dist, pred, and what is carried) for each node that a search reaches.

    ``arcs`` (id, nbr) are one-way; ``costs`` (id, cost, and more columns if rules want them) are paid on
    entering a node and not negative; ``sources`` (key, id, dist, and the columns ``carry``) start the
    searches, several of a key if wanted. Of equally cheap ways the one with the least carried values, then
    the least node before, counts. ``price`` replaces the cost of a step, ``allowed`` leaves steps out,
    and a key of which a label fulfils ``done`` is searched no further; they are expressions over key, at,
    id, cost, dist and the columns of ``costs`` and ``carry``. ``width`` is that of a bucket: the mean
    positive cost unless given."""
    out = written(arcs.select(F.col("id").alias("at"), F.col("nbr").alias("id")).join(costs, "id"), "priced_arcs")
    if width is None:
        width = float(costs.where("cost > 0").agg(F.avg("cost")).first()[0] or 1.0)
    kept = ["key", "id", "dist", *carry, "pred", "new"]
    labels = sources.select("key", "id", F.col("dist").cast("double"), *carry, F.lit(None).cast("long").alias("pred"), F.lit(True).alias("new"))
    best = F.min(F.struct("dist", *carry, "pred", "new")).alias("s")
    labels = written(labels.groupBy("key", "id").agg(best).select("key", "id", "s.*"), "labels")
    step_price = F.col("cost") if price is None else price
    for _ in range(most_rounds):
        least = labels.where("new").agg(F.min("dist")).first()[0]
        if least is None:
            dropped(out)
            return labels.drop("new")
        limit = (least // width + 1) * width
        front = labels.where(F.col("new") & (F.col("dist") < limit)).select("key", F.col("id").alias("at"), F.col("dist").alias("before"), *carry)
        step = front.join(out, "at").withColumn("dist", F.col("before") + step_price)
        if allowed is not None:
            step = step.where(allowed)
        step = step.select("key", "id", "dist", *carry, F.col("at").alias("pred"), F.lit(True).alias("new"))
        old = labels.withColumn("new", F.col("new") & (F.col("dist") >= limit))
        both = old.unionByName(step).groupBy("key", "id").agg(best)  # of equal labels the old one, no longer new
        after = both.select("key", "id", "s.*")
        if done is not None:
            ended = after.groupBy("key").agg(F.bool_or(done).alias("_e")).where("_e").select("key", "_e")
            after = after.join(ended, "key", "left").select(*kept[:-1], (F.col("new") & F.col("_e").isNull()).alias("new"))
        after = written(after.select(*kept), "labels")
        dropped(labels)
        labels = after
    raise RuntimeError(f"paths did not settle in {most_rounds} rounds")


def nearest_sources(g: ScoredGraph, sources: DataFrame, width: float | None = None) -> DataFrame:
    """(id, dist, source, pred): the cheapest way to each node from one of ``sources`` (id), and so the
    regions of the nodes around each. Nodes that none reaches have no row."""
    start = sources.select(F.lit(0).alias("key"), "id", F.lit(0.0).alias("dist"), F.col("id").alias("source"))
    return least_costs(symmetric(g.edges), entry_costs(g), start, ("source",), width=width).select("id", "dist", "source", "pred")


def all_pairs(g: ScoredGraph, starts: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """(start, id, dist, pred): the cheapest ways from each of ``starts`` (id), all nodes unless given, to
    every node that it reaches; a row for each pair, which is what is asked for."""
    starts = g.nodes.select("id") if starts is None else starts
    start = starts.select(F.col("id").alias("key"), "id", F.lit(0.0).alias("dist"))
    return least_costs(symmetric(g.edges), entry_costs(g), start, width=width).withColumnRenamed("key", "start")
