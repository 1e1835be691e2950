"""Networks from text: label lists, STP files and solution files.

All are read by line, large files by many tasks. Of section files the few lines that begin a section reach
the driver; every other line learns its section from its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.operators.ranking import numbered
from scorenet.plans.pcst import pcst_graph
from scorenet.storage import written

#: Most sections of a file.
MOST_SECTIONS = 1000
NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
STP_MAGIC = "33D32945"  # fixed value of the format


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, at, t): lines, ended by LF, CRLF or CR, as tokens; empty and # lines are left out. ``at`` is
    their order, the split's place in the file and the line's in the split; ids are unique, and ascend in
    that order within a split. Large files are read by many tasks."""
    place = F.monotonically_increasing_id()
    rows = spark.read.text(path).select("value", place.alias("id"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), place.alias("n")).alias("at"))
    rows = rows.where("trim(value) <> '' and not startswith(value, '#')")
    return rows.select("id", "at", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))


def read_labels(spark: SparkSession, nodes_path: str, edges_path: str, pvalues: bool = False) -> ScoredGraph:
    """A node list (label number) and an edge list (label label). The first of repeated labels counts; a
    missing or non-numeric number, or an edge line of one token, is an error; edges to unknown labels
    and self-loops are dropped."""
    lines = _lines(spark, nodes_path)
    value = F.when((F.size("t") >= 2) & F.regexp_like(F.get("t", F.lit(1)), F.lit(f"^{NUMBER}$")), F.get("t", F.lit(1)).cast("double")).otherwise(F.raise_error(F.lit("malformed node line")).cast("double"))
    rows = lines.select("id", "at", F.get("t", F.lit(0)).alias("label"), value.alias("x"))
    nodes = written(rows.groupBy("label").agg(F.min_by(F.struct("id", "x"), "at").alias("r")).select("r.id", "label", "r.x"), "labels")
    nodes = nodes.select("id", "label", *([F.lit(None).cast("double").alias("score"), F.col("x").alias("pval")] if pvalues else [F.col("x").alias("score")]))
    pair = _lines(spark, edges_path).select(F.get("t", F.lit(0)).alias("a"), F.when(F.size("t") >= 2, F.get("t", F.lit(1))).otherwise(F.raise_error(F.lit("malformed edge line")).cast("string")).alias("b"))
    ids = nodes.select("id", "label")
    edges = pair.join(ids.select(F.col("id").alias("u"), F.col("label").alias("a")), "a").join(ids.select(F.col("id").alias("v"), F.col("label").alias("b")), "b")
    return ScoredGraph.of(nodes, edges.select("u", "v"))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(start, n, value, t): lines that are not empty with their tokens. ``start`` is the split's place in
    the file and ``n`` ascends in it, so both together are the lines' order."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    return rows.where("trim(value) <> ''").select("start", "n", "value", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))


def _sectioned(rows: DataFrame, head, name) -> tuple[DataFrame, list]:
    """``rows`` with ``section``, the ``name`` of the last row before it (or itself) that is a ``head``, and
    those heads: a section file has a few, which reach the driver; its other lines stay where they are."""
    heads = rows.where(head).select("start", "n", name.alias("name")).orderBy("start", "n").limit(MOST_SECTIONS + 1).collect()
    if len(heads) > MOST_SECTIONS:
        raise ValueError("too many sections")
    section = F.lit("")
    for h in heads:
        section = F.when((F.col("start") > h.start) | ((F.col("start") == h.start) & (F.col("n") >= h.n)), h.name).otherwise(section)
    return rows.withColumn("section", section), heads


def _section_rows(spark: SparkSession, path: str) -> DataFrame:
    """(section, head, t, value, start, n) of a file's lines, section and first token in lower case."""
    first = F.lower(F.get("t", F.lit(0)))
    rows, _ = _sectioned(_rows(spark, path), first == "section", F.lower(F.get("t", F.lit(1))))
    return rows.select("section", first.alias("head"), "t", "value", "start", "n")


def _token(k: int, kind: str):
    return F.get("t", F.lit(k)).try_cast(kind)


def stp_tables(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """(number of nodes, edges (u, v, cost), terminals (id, weight), roots (id)) of an STP file, which many
    tasks read. Counts that differ from the rows, edges to unknown nodes, and rows that lack a number are
    errors; an edge may lack its cost."""
    rows = written(_section_rows(spark, path), "section_rows")
    top = rows.agg(F.min_by("value", F.struct("start", "n"))).first()[0]
    if not (top or "").startswith(STP_MAGIC):
        raise ValueError("not an STP file")
    said = {(r.section, r.head): r.x for r in rows.where("(section = 'graph' and head in ('nodes', 'edges')) or (section = 'terminals' and head = 'terminals')").select("section", "head", _token(1, "long").alias("x")).collect()}  # three rows
    n, m, t = said.get(("graph", "nodes")), said.get(("graph", "edges")), said.get(("terminals", "terminals"))
    if n is None:
        raise ValueError("the number of nodes is missing")
    edges = rows.where("section = 'graph' and head = 'e'").select(_token(1, "long").alias("u"), _token(2, "long").alias("v"), _token(3, "double").alias("cost"), F.size("t").alias("k"))
    ends = rows.where("section = 'terminals' and head in ('t', 'tp')").select(_token(1, "long").alias("id"), _token(2, "double").alias("weight"))
    roots = rows.where("section = 'terminals' and head = 'rootp'").select(_token(1, "long").alias("id"))
    inside = F.col("u").between(1, n) & F.col("v").between(1, n)
    got = edges.agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("odd"), F.count_if((F.col("k") > 3) & F.col("cost").isNull()).alias("bad")).first()
    if got.odd:
        raise ValueError(f"{got.odd} edges name unknown nodes")
    # A terminal given twice counts once, so that the counts differ.
    has = ends.agg(F.countDistinct("id").alias("t"), F.count_if(F.col("id").isNull() | F.col("weight").isNull()).alias("bad")).first()
    if got.bad or has.bad:
        raise ValueError("a number is malformed")
    if (m or 0) != got.m or (t or 0) != has.t + roots.count():
        raise ValueError("counts and rows differ")
    return n, edges.select("u", "v", "cost"), ends, roots


def read_stp(spark: SparkSession, path: str) -> ScoredGraph:
    """A weighted network: every node must be a terminal with its weight."""
    n, edges, ends, _ = stp_tables(spark, path)
    if ends.count() != n:
        raise ValueError("every node needs a weight")
    return ScoredGraph.of(ends.select("id", F.col("weight").alias("score")), edges.select("u", "v"))


def read_stp_pcst(spark: SparkSession, path: str) -> tuple[ScoredGraph, float]:
    """A prize-collecting instance as a scored network (``pcst_graph``), and the sum of prizes; roots
    have no prize. An edge without a cost costs nothing."""
    n, edges, ends, roots = stp_tables(spark, path)
    nodes = spark.range(1, n + 1).join(ends, "id", "left").join(roots.select("id", F.lit(True).alias("r")), "id", "left")
    nodes = nodes.select("id", F.coalesce("weight", F.lit(0.0)).alias("prize"), F.coalesce("r", F.lit(False)).alias("is_root"))
    g = pcst_graph(nodes, edges.select("u", "v", F.coalesce("cost", F.lit(0.0)).alias("cost")))
    return g, nodes.where("not is_root").agg(F.coalesce(F.sum("prize"), F.lit(0.0))).first()[0]


def read_dat(spark: SparkSession, path: str) -> ScoredGraph:
    """A network from a .dat file: a line that starts with ``node``, a heading, rows (number from 0, x, y,
    weight); a line that starts with ``link``, a heading, rows (number, node, node). Ids are the numbers
    and one, as STP files count from 1. A node out of turn is an error."""
    rows, heads = _sectioned(_rows(spark, path), F.regexp_like("value", F.lit("^(node|link)")), F.substring("value", 1, 4))
    rows = written(rows, "dat_rows")
    at = F.struct("start", "n")
    skip = F.lit(False)
    for h in heads:  # its own line and the heading after it
        skip = skip | ((F.col("start") == h.start) & (F.col("n") == h.n))
        next_ = rows.where((F.col("start") > h.start) | ((F.col("start") == h.start) & (F.col("n") > h.n))).agg(F.min(at).alias("a")).first().a
        if next_ is not None:
            skip = skip | ((F.col("start") == next_.start) & (F.col("n") == next_.n))
    rows = rows.where(~skip)
    nodes = numbered(rows.where("section = 'node'").select("start", "n", _token(0, "long").alias("number"), _token(3, "double").alias("score")), "start", "n")
    odd = nodes.where((F.col("number") != F.col("k") - 1) | F.col("number").isNull() | F.col("score").isNull()).select("k").limit(1).collect()
    if odd:
        raise ValueError(f"node row {odd[0].k} out of turn")
    links = rows.where("section = 'link'").select((_token(1, "long") + 1).alias("u"), (_token(2, "long") + 1).alias("v"))
    return ScoredGraph.of(nodes.select(F.col("k").alias("id"), "score"), links)


#: The fields of a run's log that a summary row has, in order.
RUN_FIELDS = ("Name", "Problem", "Program", "Threads", "Time", "Dual", "Primal")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, problem, program, threads, time, dual, primal): one row for each run log at ``path``,
    the first value of each field as text, quotes kept; null where a log lacks it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("w"))
    pick = [F.min(F.when(F.col("w")[0] == f, F.get("w", F.lit(1)))).alias(f.lower()) for f in RUN_FIELDS]
    return lines.groupBy("file").agg(*pick)


def toy_graphs(spark: SparkSession) -> tuple[ScoredGraph, ScoredGraph]:
    """Two small networks for trials: eight nodes with ten edges, and a path of three nodes."""
    # Scores by id from 1, and edges.
    eight = [5, -4, -5, 30, -5, -15, 10, 10]
    ten = [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (4, 6), (3, 5), (6, 8), (6, 7), (5, 6)]
    three, two = [5, -1, 5], [(1, 2), (3, 2)]
    make = lambda w, e: ScoredGraph.of(spark.createDataFrame(list(enumerate(map(float, w), 1)), "id long, score double"), spark.createDataFrame(e, "u long, v long"))
    return make(eight, ten), make(three, two)


def read_solution(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(label) and (a, b) of the final section of a solution file; an edge with an end that the vertices
    lack is an error."""
    rows = written(_section_rows(spark, path).where("section = 'finalsolution'").select("t"), "solution_rows")
    kind = F.get("t", F.lit(0))
    nodes = rows.where(kind == "V").select(F.get("t", F.lit(1)).alias("label"))
    edges = rows.where(kind == "E").select(F.get("t", F.lit(1)).alias("a"), F.get("t", F.lit(2)).alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("label"))
    if not ends.join(nodes, "label", "left_anti").isEmpty():
        raise ValueError("an edge names an unknown vertex")
    return nodes, edges
