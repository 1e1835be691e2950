"""The scored network: immutable tables, and the operations that change it into another network."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.storage import written

NODE_SCHEMA = "id long, label string, score double, pval double, is_root boolean"
EDGE_SCHEMA = "u long, v long"


#: Rows of a task that drops repeats of edges or of their ends. Pairs of near numbers are packed so well in a shuffle that
#: tasks dealt by its bytes would hold many times more.
TASK_ROWS = 200_000


def canonical_edges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct undirected pairs u < v, without self-loops and null ends; dealt to ``parts`` tasks if given."""
    pairs = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    return (pairs if parts is None else pairs.repartition(parts, "u", "v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(id, nbr): both directions of each edge, from one reading of them."""
    ways = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("id"), F.col("u").alias("nbr")))
    return edges.select(F.inline(ways))


@dataclass(frozen=True)
class ScoredGraph:
    """nodes (id, label, score, pval, is_root), edges (u, v) simple with u < v, and node_map
    (pre_id, org_id): which original nodes a node stands for, many to many."""

    nodes: DataFrame
    edges: DataFrame
    node_map: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> ScoredGraph:
        """From tables of one's own. Missing columns: label is the id as text, no p-value, no root.
        Edges to unknown nodes, self-loops, repeats and reversals are dropped."""
        have = set(nodes.columns)
        nodes = nodes.select(
            F.col("id").cast("long"), (F.col("label").cast("string") if "label" in have else F.col("id").cast("string")).alias("label"),
            F.col("score").cast("double") if "score" in have else F.lit(None).cast("double").alias("score"),
            (F.col("pval").cast("double") if "pval" in have else F.lit(None).cast("double")).alias("pval"),
            (F.coalesce(F.col("is_root"), F.lit(False)) if "is_root" in have else F.lit(False)).alias("is_root"),
        )
        known = nodes.select("id")
        edges = canonical_edges(edges)
        edges = edges.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
        return ScoredGraph(nodes, edges, nodes.select(F.col("id").alias("pre_id"), F.col("id").alias("org_id")))

    @staticmethod
    def of_ends(weights: DataFrame, edges: DataFrame) -> ScoredGraph:
        """The network of all ends of raw ``edges`` (u, v) that have a row in ``weights`` (id, score),
        which names each node once; edges to others are dropped. Its tables are written, edges first and
        nodes from them, so that what is asked of it reads the network and not what it came from."""
        edges = written(canonical_edges(edges, max(1, -(-edges.count() // TASK_ROWS))), "graph_edges")
        parts = max(1, -(-2 * edges.count() // TASK_ROWS))
        ends = edges.select(F.explode(F.array("u", "v")).alias("id")).repartition(parts, "id").distinct()
        rows = ends.join(weights.select(F.col("id").cast("long"), F.col("score").cast("double"), F.lit(True).alias("_w")).repartition(parts, "id"), "id", "left")
        nodes = rows.select("id", F.col("id").cast("string").alias("label"), "score", F.lit(None).cast("double").alias("pval"), F.lit(False).alias("is_root"), "_w")
        nodes = written(nodes, "nodes")
        unknown = nodes.where("_w is null").select("id")
        if not unknown.isEmpty():
            edges = edges.join(unknown.withColumnRenamed("id", "u"), "u", "left_anti").join(unknown.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v")
        nodes = nodes.where("_w").drop("_w")
        return ScoredGraph(nodes, edges, nodes.select(F.col("id").alias("pre_id"), F.col("id").alias("org_id")))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def stored(self) -> ScoredGraph:
        """The same network with its tables written, which ends their lineage."""
        return ScoredGraph(written(self.nodes, "nodes"), written(self.edges, "graph_edges"), written(self.node_map, "node_map"))

    def reset(self) -> ScoredGraph:
        """Back to the identity map, as after scoring anew."""
        return replace(self, node_map=self.nodes.select(F.col("id").alias("pre_id"), F.col("id").alias("org_id")))

    def without(self, ids: DataFrame) -> ScoredGraph:
        """Nodes ``ids`` (id) removed, with their edges and provenance."""
        gone = ids.select("id")
        return ScoredGraph(
            self.nodes.join(gone, "id", "left_anti"),
            self.edges.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v"),
            self.node_map.join(gone.withColumnRenamed("id", "pre_id"), "pre_id", "left_anti"),
        )

    def without_edges(self, edges: DataFrame) -> ScoredGraph:
        return replace(self, edges=self.edges.join(canonical_edges(edges), ["u", "v"], "left_anti"))

    def with_edges(self, edges: DataFrame) -> ScoredGraph:
        return replace(self, edges=canonical_edges(self.edges.unionByName(edges.select("u", "v"))))

    def merged(self, merge: DataFrame) -> ScoredGraph:
        """Nodes contracted by ``merge`` (old, new): scores add, neighbours unite, parallel edges and
        loops go, the kept node's label stays, and provenance unites; ``joined_labels`` has the others'."""
        m = merge.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        nodes = self.nodes.join(m, F.col("id") == F.col("_old"), "left").withColumn("_to", F.coalesce("_new", "id"))
        kept = F.max_by("label", F.struct((F.col("id") == F.col("_to")).alias("k"), (-F.col("id")).alias("i")))
        nodes = nodes.groupBy(F.col("_to").alias("id")).agg(kept.alias("label"), F.sum("score").alias("score"), F.min("pval").alias("pval"), F.bool_or("is_root").alias("is_root"))
        edges = self.edges.join(m, F.col("u") == F.col("_old"), "left").select(F.coalesce("_new", "u").alias("u"), "v")
        edges = edges.join(m, F.col("v") == F.col("_old"), "left").select("u", F.coalesce("_new", "v").alias("v"))
        back = self.node_map.join(m, F.col("pre_id") == F.col("_old"), "left").select(F.coalesce("_new", "pre_id").alias("pre_id"), "org_id").distinct()
        return ScoredGraph(nodes, canonical_edges(edges), back)

    def extracted(self, sets: DataFrame) -> ScoredGraph:
        """For each set (set_id new, id member) an isolated node ``set_id`` with the summed score, which
        shares the members' originals; the members stay."""
        got = sets.join(self.nodes, "id").groupBy("set_id").agg(F.min("label").alias("label"), F.sum("score").alias("score"))
        fresh = got.select(F.col("set_id").alias("id"), "label", "score", F.lit(None).cast("double").alias("pval"), F.lit(False).alias("is_root"))
        back = sets.join(self.node_map, F.col("id") == F.col("pre_id")).select(F.col("set_id").alias("pre_id"), "org_id").distinct()
        return ScoredGraph(self.nodes.unionByName(fresh), self.edges, self.node_map.unionByName(back))

    def originals(self, ids: DataFrame) -> DataFrame:
        """(id) of the original nodes that nodes ``ids`` (id) stand for."""
        return self.node_map.join(ids.select(F.col("id").alias("pre_id")), "pre_id", "left_semi").select(F.col("org_id").alias("id")).distinct()

    def joined_labels(self, before: ScoredGraph) -> DataFrame:
        """(id, label) with the labels that the nodes of ``before``, of which this network came, had: the
        kept node's first, then the others' by id, joined by "_". For writing networks that a person reads:
        a node that stands for many has them all in one string."""
        own = self.node_map.join(before.nodes.select(F.col("id").alias("org_id"), "label"), "org_id")
        rows = F.array_sort(F.collect_list(F.struct((F.col("org_id") != F.col("pre_id")).alias("o"), "org_id", "label")))
        return own.groupBy(F.col("pre_id").alias("id")).agg(F.array_join(F.transform(rows, lambda x: x["label"]), "_").alias("label"))

    def by_label(self, labels: list[str]) -> DataFrame:
        """(id) of the nodes with one of the labels; none if there is none."""
        return self.nodes.where(F.col("label").isin(labels)).select("id")

    def with_roots(self, ids: DataFrame) -> ScoredGraph:
        marked = self.nodes.drop("is_root").join(ids.select("id", F.lit(True).alias("_r")).distinct(), "id", "left")
        return replace(self, nodes=marked.select("id", "label", "score", "pval", F.coalesce("_r", F.lit(False)).alias("is_root")))


def induced(g: ScoredGraph, ids: DataFrame) -> ScoredGraph:
    """The subgraph of nodes ``ids`` (id): edges with both ends in it."""
    keep = ids.select("id")
    edges = g.edges.join(keep.withColumnRenamed("id", "u"), "u", "left_semi").join(keep.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    return ScoredGraph(g.nodes.join(keep, "id", "left_semi"), edges, g.node_map.join(keep.withColumnRenamed("id", "pre_id"), "pre_id", "left_semi"))
