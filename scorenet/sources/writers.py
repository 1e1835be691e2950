"""Networks and modules as text: each writer gives a DataFrame (n, value) of numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.operators.ranking import numbered


def _numbered(*parts: DataFrame) -> DataFrame:
    """Parts (key, value) one after another, each in order of its key."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), F.col("key").cast("string").alias("key"), "value")
        out = p if out is None else out.unionByName(p)
    return out


def _line(g: ScoredGraph, text) -> DataFrame:
    return g.spark.range(1).select(F.lit("").alias("key"), (text if not isinstance(text, str) else F.lit(text)).alias("value"))


def _key(col):
    return F.lpad(col.cast("string"), 20, "0")


def module_table(g: ScoredGraph, originals: DataFrame, module: DataFrame) -> DataFrame:
    """Every original node (id, label, score) with its score if any node it became is in the module
    (id), else NaN; a header and the total."""
    ids = g.originals(module).select(F.col("id"), F.lit(True).alias("_in"))
    rows = originals.join(ids, "id", "left").withColumn("x", F.when(F.col("_in"), F.col("score")).otherwise(F.lit(float("nan"))))
    total = rows.where("_in").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"))
    return _numbered(_line(g, "#label\tscore"), rows.select(_key(F.col("id")).alias("key"), F.concat_ws("\t", "label", F.col("x").cast("string")).alias("value")), total.select(F.lit("").alias("key"), F.concat(F.lit("#total score\t"), F.col("s").cast("string")).alias("value")))


def graphviz(g: ScoredGraph, module: DataFrame | None = None) -> DataFrame:
    """The network for drawing, or its part that a ``module`` (id) induces; boxes are negative nodes, and
    p-values stand under the scores where there are any."""
    from scorenet.operators.topology import induced

    if module is not None:
        g = induced(g, module)
    text = F.concat_ws("\\n", "label", F.col("score").cast("string"), F.col("pval").cast("string"))
    node = F.concat(F.lit("\t"), "id", F.lit(' [label="'), text, F.lit('"'), F.when(F.col("score") < 0, F.lit(",shape=box")).otherwise(F.lit("")), F.lit("]"))
    total = g.nodes.agg(F.concat(F.lit('\tlabel="Total weight: '), F.coalesce(F.sum("score"), F.lit(0.0)).cast("string"), F.lit('"')).alias("value")).select(F.lit("").alias("key"), "value")
    edges = g.edges.select(F.concat(_key(F.col("u")), _key(F.col("v"))).alias("key"), F.concat(F.lit("\t"), "u", F.lit(" -- "), "v").alias("value"))
    return _numbered(_line(g, "graph G {"), total, g.nodes.select(_key(F.col("id")).alias("key"), node.alias("value")), edges, _line(g, "}"))


def node_list(g: ScoredGraph) -> DataFrame:
    return _numbered(g.nodes.select(_key(F.col("id")).alias("key"), F.concat_ws(" ", "id", F.col("score").cast("string"), "label", F.col("pval").cast("string")).alias("value")))


def stp(g: ScoredGraph, name: str = "network") -> DataFrame:
    """A weighted STP file; nodes are numbered from 1 in order of id."""
    ids = numbered(g.nodes.select("id", "score"), "id")
    edges = g.edges.join(ids.select(F.col("id").alias("u"), F.col("k").alias("a")), "u").join(ids.select(F.col("id").alias("v"), F.col("k").alias("b")), "v")
    count = lambda df, w: df.agg(F.concat(F.lit(w + " "), F.count(F.lit(1))).alias("value")).select(F.lit("").alias("key"), "value")
    return _numbered(
        _line(g, "33D32945 STP File, STP Format Version 1.0"), _line(g, "SECTION Comment"), _line(g, f'Name "{name}"'), _line(g, "END"), _line(g, "SECTION Graph"), count(g.nodes, "Nodes"), count(g.edges, "Edges"),
        edges.select(F.concat(_key(F.col("a")), _key(F.col("b"))).alias("key"), F.concat_ws(" ", F.lit("E"), "a", "b").alias("value")), _line(g, "END"), _line(g, "SECTION Terminals"), count(g.nodes, "Terminals"),
        ids.select(_key(F.col("k")).alias("key"), F.concat_ws(" ", F.lit("T"), "k", F.col("score").cast("string")).alias("value")), _line(g, "END"), _line(g, "EOF"),
    )


def solution(g: ScoredGraph, ids: DataFrame) -> DataFrame:
    """The final section of a solution file: vertices of the module and the edges between them. Labels
    "u--v" are edges of a prize-collecting instance."""
    from scorenet.operators.topology import induced

    part = induced(g, ids)
    own = part.nodes.withColumn("_e", F.regexp_like("label", F.lit(r"^\d+--\d+$")))
    pairs = own.where("_e").select(F.regexp_extract("label", r"^(\d+)--", 1).alias("a"), F.regexp_extract("label", r"--(\d+)$", 1).alias("b"))
    labels = own.where("not _e").select("id", "label")
    direct = part.edges.join(labels.select(F.col("id").alias("u"), F.col("label").alias("a")), "u").join(labels.select(F.col("id").alias("v"), F.col("label").alias("b")), "v").select("a", "b")
    edges = pairs.union(direct)
    count = lambda df, w: df.agg(F.concat(F.lit(w + " "), F.count(F.lit(1))).alias("value")).select(F.lit("").alias("key"), "value")
    return _numbered(_line(g, "SECTION Finalsolution"), count(labels, "Vertices"), labels.select(F.col("label").alias("key"), F.concat(F.lit("V "), "label").alias("value")), count(edges, "Edges"), edges.select(F.concat_ws(" ", "a", "b").alias("key"), F.concat_ws(" ", F.lit("E"), "a", "b").alias("value")), _line(g, "End"))


def save(lines: DataFrame, path: str) -> None:
    """Write the lines in order, as one file: a file of one network."""
    lines.orderBy("part", "key").select("value").coalesce(1).write.text(path)


def comment_section(name: str, problem: str, program: str, version: str) -> list[str]:
    return ["SECTION Comment", f"Name {name}", f'Problem "{problem}"', f'Program "{program}"', f'Version "{version}"', "End", ""]


def run_section(threads: int, seconds: float, primal: float, dual: float | None = None, trace: list[tuple[float, float]] = ()) -> list[str]:
    """The run of a solver: better solutions as they were found, then threads, time, bound if there is
    one, and value."""
    found = ["SECTION Solutions", *(f"Solution {t:g} {v:.10g}" for t, v in trace), "End", ""] if trace else []
    return [*found, "SECTION Run", f"Threads {threads}", f"Time {seconds:g}", *([] if dual is None else [f"Dual {dual:.10g}"]), f"Primal {primal:.10g}", "End", ""]


def edge_list(g: ScoredGraph, blocks: DataFrame | None = None) -> DataFrame:
    """One line for each edge: the ends' labels with "(pp)" between, and the block that it lies in if
    ``blocks`` (comp, block, u, v) are given."""
    label = g.nodes.select("id", "label")
    rows = g.edges.join(label.select(F.col("id").alias("u"), F.col("label").alias("a")), "u").join(label.select(F.col("id").alias("v"), F.col("label").alias("b")), "v")
    text = F.concat_ws(" ", "a", F.lit("(pp)"), "b")
    if blocks is not None:
        rows = rows.join(blocks.select("u", "v", "comp", "block"), ["u", "v"], "left")
        text = F.concat(text, F.lit("\t"), "comp", F.lit("."), "block")
    return _numbered(rows.select(F.concat(_key(F.col("u")), _key(F.col("v"))).alias("key"), text.alias("value")))


def lgf(g: ScoredGraph) -> DataFrame:
    """The network in the LEMON graph format: nodes with label and score, edges by the nodes' ids."""
    node = F.concat_ws("\t", "id", F.concat(F.lit('"'), "label", F.lit('"')), F.col("score").cast("string"))
    edge = F.concat_ws("\t", F.col("u").cast("string"), F.col("v").cast("string"))
    return _numbered(
        _line(g, "@nodes"), _line(g, "label\tname\tscore"), g.nodes.select(_key(F.col("id")).alias("key"), node.alias("value")),
        _line(g, "@edges"), _line(g, "\t\t-"), g.edges.select(F.concat(_key(F.col("u")), _key(F.col("v"))).alias("key"), edge.alias("value")),
    )


def solution_lines(g: ScoredGraph, ids: DataFrame, score: float) -> DataFrame:
    """The module as comments: its score, then a line for each node with label and score."""
    own = g.nodes.join(ids.select("id"), "id", "left_semi")
    return _numbered(_line(g, f"// Score: {score:.10g}"), own.select(_key(F.col("id")).alias("key"), F.concat(F.lit("// "), "label", F.lit(" "), F.col("score").cast("string")).alias("value")))


def rows_as_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Any table as lines of its columns, in their order: hubs, classes, paths, block-cut trees."""
    return _numbered(rows.select(F.concat_ws("\t", *(F.lpad(F.col(c).cast("string"), 20, "0") for c in columns)).alias("key"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("value")))
