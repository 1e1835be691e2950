"""Command line: ``python -m scorenet.cli COMMAND``. Commands and what they give back:

solve       find the best module; 0, or 1 for input that cannot be read or has no solution
check       hold a solution file against its instance; 0 if it is valid, else 1
print       write a network: graphviz, node list, edge list, STP or LGF
pvalue      the share of permuted networks whose module scores no less
convert     a .dat network as an STP file
runs        run logs as one table
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.functions import scoring
from scorenet.graph import ScoredGraph
from scorenet.operators import topology
from scorenet.plans import reduce, solve
from scorenet.sources import text, writers

VERSION = "0.2"
#: Variants of a benchmark run by name: whether the network is reduced, and whether it is solved by drawn
#: trees instead of exactly. Exact search always goes by components and blocks.
VARIANTS = {"no_pre": (False, False), "no_dc": (True, False), "dc": (True, False), "mc": (True, True)}


def _session(threads: int) -> SparkSession:
    found = SparkSession.getActiveSession()
    if found:
        return found
    spark = SparkSession.builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", str(max(2, threads))).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _network(spark: SparkSession, a) -> tuple[ScoredGraph, float | None]:
    """The network of the arguments, and the sum of prizes if it is a prize-collecting instance."""
    if a.pcst:
        return text.read_stp_pcst(spark, a.pcst)
    if a.stp:
        g, prizes = text.read_stp(spark, a.stp), None
    elif a.nodes and a.edges:
        scored = a.tau is not None or a.fdr is not None
        g, prizes = text.read_labels(spark, a.nodes, a.edges, pvalues=scored), None
        if scored:
            p = F.col("pval")
            if (a.lambda_ is None) != (a.a is None):
                raise ValueError("-lambda and -a go together")
            tau = a.tau if a.tau is not None else a.fdr if a.lambda_ is None else None
            score = scoring.score_tau(p, tau) if tau is not None else scoring.score_bum(p, a.lambda_, a.a, a.fdr)
            g = ScoredGraph(g.nodes.withColumn("score", score), g.edges, g.node_map)
    else:
        raise ValueError("give -stp, -pcst, or -n and -e")
    if a.root:
        ids = g.by_label(a.root)
        if ids.count() != len(set(a.root)):
            raise ValueError("a root is not in the network")
        g = g.with_roots(ids)
    return g, prizes


def _put(lines: DataFrame | list[str], path: str | None) -> None:
    """One network's lines, at most a few million, to a file of this machine or to standard output."""
    rows = lines if isinstance(lines, list) else [r.value for r in lines.orderBy("part", "key").select("value").toLocalIterator()]
    if path in (None, "-"):
        print("\n".join(rows))
    else:
        with open(path, "w") as f:
            f.write("\n".join(rows) + "\n")


def _solve(spark: SparkSession, a) -> int:
    began = time.monotonic()
    g, prizes = _network(spark, a)
    pre, drawn = VARIANTS[a.variant] if a.variant else (not a.p, a.mc > 0)
    if drawn:
        got = solve.monte_carlo(g, a.mc or 20, a.strategy, reduce=pre, seconds=a.t, hubs=a.hubs)
    else:
        got = solve.solve(g, a.t, reduce=pre)
    b = got.bounds.first()
    if b.status == "INFEASIBLE":
        print("no module holds all roots", file=sys.stderr)
        return 1
    value, bound = (b.score, b.ub) if prizes is None else (prizes - b.score, prizes - b.ub)
    turned = (lambda v: v) if prizes is None else lambda v: prizes - v
    trace = [(round(t, 3), turned(v)) for t, v in got.trace if v < b.score] + [(round(time.monotonic() - began, 3), value)]
    if a.v > 0:
        print(f"{b.status} score {b.score:.10g} bound {b.ub:.10g}" + ("" if prizes is None else f" cost {value:.10g}"), file=sys.stderr)
    name = (a.stp or a.pcst or a.nodes).rpartition("/")[2].rpartition(".")[0]
    problem = "MWCS" if prizes is None else "RPCST" if g.nodes.where("is_root").limit(1).count() else "PCST"
    head = [*writers.comment_section(f'"{name}"', problem, "scorenet", VERSION), *writers.run_section(a.m, round(time.monotonic() - began, 3), value, bound, trace)]
    if a.o:
        _put([*head, *(r.value for r in writers.solution(g, got.ids).orderBy("part", "key").collect())], a.o)
    else:
        _put(writers.module_table(g, g.nodes, got.ids), None)
    return 0


def check_file(spark: SparkSession, path: str, solution: str, pcst: bool = False) -> list[str]:
    """What is wrong with a solution file; nothing if it is valid: its vertices and edges are the
    instance's, hang together, and hold all roots. An empty module is valid."""
    g, _ = text.read_stp_pcst(spark, path) if pcst else (text.read_stp(spark, path), None)
    labels, edges = text.read_solution(spark, solution)
    faults = []
    ids = labels.distinct().join(g.nodes.select("id", "label"), "label", "left")
    for r in ids.where("id is null").orderBy("label").limit(20).collect():
        faults.append(f"vertex {r.label} is not in the instance")
    if pcst:
        mids = g.nodes.select("id", "label")
        named = edges.select("a", "b", F.concat("a", F.lit("--"), "b").alias("x"), F.concat("b", F.lit("--"), "a").alias("y"))
        hit = named.join(mids.select(F.col("label").alias("x"), F.col("id").alias("i")), "x", "left").join(mids.select(F.col("label").alias("y"), F.col("id").alias("j")), "y", "left")
        hit = hit.select("a", "b", F.coalesce("i", "j").alias("id"))
        for r in hit.where("id is null").limit(20).collect():
            faults.append(f"edge {r.a} {r.b} is not in the instance")
        module = ids.select("id").union(hit.select("id")).where("id is not null")
        own = None
    else:
        byl = g.nodes.select("id", "label")
        own = edges.join(byl.select(F.col("label").alias("a"), F.col("id").alias("u")), "a").join(byl.select(F.col("label").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
        module = ids.where("id is not null").select("id")
    got = solve.check_solution(g, module, own).first()
    if got.unknown_edges:
        faults.append(f"{got.unknown_edges} edges are not in the instance")
    if got.n_components > 1:
        faults.append(f"the solution falls into {got.n_components} parts")
    if got.missing_roots:
        faults.append(f"{got.missing_roots} roots are left out")
    return faults


def _check(spark: SparkSession, a) -> int:
    faults = check_file(spark, a.pcst or a.stp, a.s, bool(a.pcst))
    for f in faults:
        print(f, file=sys.stderr)
    print("invalid" if faults else "valid")
    return int(bool(faults))


def _print(spark: SparkSession, a) -> int:
    g, _ = _network(spark, a)
    if not a.p:
        g = reduce.reduced(g)
    kinds = {"graphviz": writers.graphviz, "nodes": writers.node_list, "edges": lambda g: writers.edge_list(g, topology.blocks(g)), "stp": writers.stp, "lgf": writers.lgf}
    _put(kinds[a.kind](g), a.o)
    return 0


def _pvalue(spark: SparkSession, a) -> int:
    g, _ = _network(spark, a)
    best = solve.solve(g, a.t).bounds.first().score
    null = solve.permutation_null(g, a.times, a.seed, a.t)
    n, hit = null.agg(F.count(F.lit(1)), F.count_if(F.col("value") >= best)).first()
    print(f"score\t{best:.10g}\npvalue\t{(hit + 1) / (n + 1):.10g}")
    return 0


def _convert(spark: SparkSession, a) -> int:
    _put(writers.stp(text.read_dat(spark, a.dat), a.dat.rpartition("/")[2].rpartition(".")[0]), a.o)
    return 0


def _runs(spark: SparkSession, a) -> int:
    rows = text.read_runs(spark, a.path).orderBy("file").collect()  # one for each run
    _put([",".join("" if x is None else str(x) for x in r) for r in rows], a.o)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="scorenet", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--version", action="version", version=f"scorenet {VERSION}")
    sub = top.add_subparsers(required=True)

    def command(name, run, network=True):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("-m", type=int, default=1, help="threads")
        c.add_argument("-o", help="output file")
        c.add_argument("-v", type=int, default=1, help="verbosity: 0 is silent")
        if network:
            c.add_argument("-n", dest="nodes", help="node list: label and score or p-value")
            c.add_argument("-e", dest="edges", help="edge list: label and label")
            c.add_argument("-stp", help="STP file of a weighted network")
            c.add_argument("-pcst", help="STP file of a prize-collecting instance")
            c.add_argument("-tau", type=float, help="score p-values by this threshold")
            c.add_argument("-lambda", dest="lambda_", type=float)
            c.add_argument("-a", type=float, help="with -lambda: the mixture that p-values follow")
            c.add_argument("-fdr", "-FDR", dest="fdr", type=float, help="score p-values by this false discovery rate; without -lambda and -a it is the threshold itself")
            c.add_argument("-r", dest="root", action="append", help="label of a root")
            c.add_argument("-t", type=float, default=10.0, help="seconds for each component")
            c.add_argument("-p", action="store_true", help="do not reduce the network")
        return c

    c = command("solve", _solve)
    c.add_argument("-mc", type=int, default=0, help="so many drawn trees instead of an exact search")
    c.add_argument("-strategy", default="random", choices=("fixed", "random", "uniform_random", "min_max"))
    c.add_argument("-hubs", action="store_true", help="drawn trees go through sampled negative hubs first")
    c.add_argument("-variant", choices=sorted(VARIANTS))
    c = command("check", _check, False)
    c.add_argument("-stp")
    c.add_argument("-pcst")
    c.add_argument("-s", required=True, help="solution file")
    c = command("print", _print)
    c.add_argument("-kind", default="graphviz", choices=("graphviz", "nodes", "edges", "stp", "lgf"))
    c = command("pvalue", _pvalue)
    c.add_argument("-times", type=int, default=20)
    c.add_argument("-seed", type=int, default=0)
    command("convert", _convert, False).add_argument("dat")
    command("runs", _runs, False).add_argument("path")
    a = top.parse_args(argv)
    try:
        return a.run(_session(a.m), a)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
