"""Topology of a network: degrees, neighbours, subgraphs, levels, forests and blocks."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph, induced, symmetric  # noqa: F401
from scorenet.operators.components import HELD, connected_components, merge_labels
from scorenet.operators.parts import WHOLE, in_parts, streamed
from scorenet.operators.ranking import numbered
from scorenet.operators.trees import BEFORE, SMALL, Most, rooted, subtree_values
from scorenet.plans.local import blocks_under
from scorenet.storage import dropped, written


def degrees(g: ScoredGraph) -> DataFrame:
    """(id, degree) of every node, isolated ones included."""
    have = symmetric(g.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return g.nodes.select("id").join(have, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(g: ScoredGraph) -> DataFrame:
    return degrees(g).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def neighbours(g: ScoredGraph) -> DataFrame:
    """(id, nbrs): the sorted neighbours of every node that has any."""
    return symmetric(g.edges).groupBy("id").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))


def components(g: ScoredGraph) -> DataFrame:
    """(id, comp) of every node; comp is the least id of the component."""
    cc = connected_components(g.edges)
    return g.nodes.select("id").join(cc, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def summary(g: ScoredGraph) -> DataFrame:
    """(n_nodes, n_edges, n_arcs, n_components), one row."""
    n = components(g).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("id") == F.col("comp")).alias("n_components"))
    m = g.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(F.broadcast(m)).select("n_nodes", "n_edges", (2 * F.col("n_edges")).alias("n_arcs"), "n_components")


def component_scores(g: ScoredGraph) -> DataFrame:
    return components(g).join(g.nodes.select("id", "score"), "id").groupBy("comp").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("score").alias("score"))


def boundary(g: ScoredGraph, ids: DataFrame) -> DataFrame:
    """(id) of the neighbours of ``ids`` that are not in it."""
    near = symmetric(g.edges).join(ids.select("id"), "id", "left_semi")
    return near.select(F.col("nbr").alias("id")).distinct().join(ids.select("id"), "id", "left_anti")


def bfs_levels(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level, pred): distance from the nearest source; ``pred`` the least neighbour one level
    nearer, null at sources. Unreached nodes have no row; ``most`` bounds the level."""
    both = written(symmetric(edges), "arcs")
    front = written(sources.select("id", F.lit(0).alias("level"), F.lit(None).cast("long").alias("pred")).distinct(), "level")
    levels, recent, level = [front], [front], 0
    while most is None or level < most:
        level += 1
        step = front.select("id").join(both, "id").groupBy(F.col("nbr").alias("_n")).agg(F.min("id").alias("pred"))
        step = step.select(F.col("_n").alias("id"), F.lit(level).alias("level"), "pred")
        for old in recent:  # an arc from one level leads to the one before, to its own or to the next
            step = step.join(old.select("id"), "id", "left_anti")
        front = written(step, "level")
        if front.isEmpty():
            break
        recent = [recent[-1], front]
        levels.append(front)
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def forest_rows(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (a, b) between nodes 0 to n - 1, given in the order of their costs, make the
    minimum spanning forest, ascending."""
    label, live, keep = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = label[a[live]], label[b[live]]
        differ = x != y
        live, x, y = live[differ], x[differ], y[differ]
        if not len(live):
            return np.sort(np.concatenate(keep))
        best = np.full(n, len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        picked = np.unique(best[best < len(a)])
        keep.append(picked)
        label = merge_labels(label, a[picked], b[picked])


def _forest_of(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by([("cost", "ascending"), ("u", "ascending"), ("v", "ascending")])
    ends, at = np.unique(np.concatenate([rows.column("cu").to_numpy(), rows.column("cv").to_numpy()]), return_inverse=True)
    return rows.take(pa.array(forest_rows(at[: rows.num_rows], at[rows.num_rows :], len(ends))))


def _light_edges(batches, most: int | None = HELD):
    """Of a task's edges those of a minimum spanning forest of them, or of each of several parts of them:
    the others are in none of the whole."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if most is not None and n >= most:
            got = _forest_of(pa.Table.from_batches(held))
            held, n = got.to_batches(100_000), got.num_rows
            if n > most // 2:
                yield from held
                held, n = [], 0
    if held:
        yield from _forest_of(pa.Table.from_batches(held)).to_batches(100_000)


def _lightest(batches):
    return _light_edges(batches, None)


def spanning_forest(edges: DataFrame, most_rounds: int = 64, small: int = SMALL) -> DataFrame:
    """(u, v, cost) of a minimum spanning forest of ``edges`` (u, v, cost); ties go to the least (u, v), so
    the forest is unique. Each task first leaves out what is in no minimum forest of its own edges. Then
    Boruvka's rounds pick each part's least edge, until no more than ``small`` edges are left."""
    kind = ", ".join(f"{c} {t}" for c, t in [("cu", "long"), ("cv", "long"), *edges.select("cost", "u", "v").dtypes])
    now = edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "cost", "u", "v")
    now = written(now.mapInArrow(_light_edges, kind), "boruvka")
    parts = []
    for _ in range(most_rounds):
        n = now.count()
        if n <= small:
            if n:
                parts.append(written(now.coalesce(1).mapInArrow(_lightest, kind).select("u", "v", "cost"), "picked"))
                dropped(now)
            break
        ends = now.select(F.inline(F.array(F.struct(F.col("cu").alias("c"), "cost", "u", "v"), F.struct(F.col("cv").alias("c"), "cost", "u", "v"))))
        best = ends.groupBy("c").agg(F.min(F.struct("cost", "u", "v")).alias("e")).select("e.*").distinct()
        picked = written(best.join(now.select("u", "v", "cu", "cv"), ["u", "v"]), "picked")
        parts.append(picked.select("u", "v", "cost"))
        to = written(connected_components(picked.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "to")
        after = now.join(to.select(F.col("id").alias("cu"), F.col("comp").alias("a")), "cu", "left").join(to.select(F.col("id").alias("cv"), F.col("comp").alias("b")), "cv", "left")
        after = after.select(F.coalesce("a", "cu").alias("cu"), F.coalesce("b", "cv").alias("cv"), "cost", "u", "v").where("cu <> cv")
        after = written(after.mapInArrow(_light_edges, kind), "boruvka")
        dropped(now, to)
        now = after
    else:
        raise RuntimeError("the forest did not settle")
    out = edges.select("u", "v", "cost").limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out


def _blocks_of(rows: pa.Table) -> pa.Table:
    """(comp, block, u, v) of whole components (comp, u, v), by one walk around each."""
    comp = dict(zip(rows.column("u").to_pylist(), rows.column("comp").to_pylist(), strict=True))
    found = [(comp[b[0][0]], min(x for e in b for x in e if x != top), b) for top, b in blocks_under(list(zip(rows.column("u").to_pylist(), rows.column("v").to_pylist(), strict=True)))]
    out, last = [], (None, -1)
    for c, _, b in sorted(found, key=lambda r: r[:2]):
        last = (c, last[1] + 1 if c == last[0] else 0)
        out += [(*last, *e) for e in b]
    return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["comp", "block", "u", "v"])


def blocks(g: ScoredGraph, small: int = SMALL, whole: int | None = None) -> DataFrame:
    """(comp, block, u, v): the biconnected component of each edge, numbered from 0 in its component by
    the least node of it but the one nearest the component's least. Components of at most ``whole`` edges (no
    more than ``small``) are dealt to tasks, many to each, and walked around; ``blocks_by_tables`` takes the larger ones."""
    few, many, has_many = in_parts(g.edges, min(WHOLE, small) if whole is None else whole)
    near = streamed(few, _blocks_of, "comp long, block long, u long, v long")
    if not has_many:
        return written(near, "blocks")
    far = blocks_by_tables(replace(g, edges=many), small)
    return written(near.unionByName(far), "blocks")


def blocks_by_tables(g: ScoredGraph, small: int = SMALL) -> DataFrame:
    """``blocks`` by Tarjan and Vishkin's method as tables, so one giant
    component is dealt over all tasks: places in a walk around a spanning tree, the first and last places
    that edges off the tree reach from each subtree, and the components of a graph that has the tree's
    edges as nodes."""
    forest = written(spanning_forest(g.edges.select("u", "v", F.lit(0).alias("cost")), small=small).select("u", "v"), "forest")
    tree = rooted(forest, small)
    place = tree.select("id", "first", "last")
    off = g.edges.join(forest, ["u", "v"], "left_anti")
    x = place.select(F.col("id").alias("u"), F.col("first").alias("fu"), F.col("last").alias("lu"))
    y = place.select(F.col("id").alias("v"), F.col("first").alias("fv"), F.col("last").alias("lv"))
    off = written(off.join(x, "u").join(y, "v"), "off_tree")
    reach = off.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("fv").alias("f")), F.struct(F.col("v").alias("id"), F.col("fu").alias("f")))))
    reach = reach.groupBy("id").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    own = tree.join(reach, "id", "left").select("id", "parent", (-F.least("first", "lo")).alias("lo"), F.greatest("first", "hi").alias("hi"))
    ends = subtree_values(own, ["lo", "hi"], Most, small).select("id", (-F.col("lo")).alias("lo"), "hi")
    above = place.select(F.col("id").alias("parent"), F.col("first").alias("fp"), F.col("last").alias("lp"))
    on = tree.where("parent is not null").select("id", "parent").join(ends, "id").join(above, "parent")
    passed = on.where((F.col("fp") > BEFORE) & ((F.col("lo") < F.col("fp")) | (F.col("hi") > F.col("lp"))))
    under = F.col("fv").between(F.col("fu"), F.col("lu"))
    over = F.col("fu").between(F.col("fv"), F.col("lv"))
    linked = passed.select(F.col("id").alias("u"), F.col("parent").alias("v")).union(off.where(~under & ~over).select("u", "v"))
    group = connected_components(linked)
    group = tree.where("parent is not null").select("id", "parent", "root").join(group, "id", "left").select("id", "parent", F.col("root").alias("comp"), F.coalesce("comp", "id").alias("rep"))
    group = written(group, "tree_blocks")
    names = written(numbered(group.select("comp", "rep").distinct(), "comp", "rep"), "block_names")
    first = names.groupBy("comp").agg(F.min("k").alias("_k"))
    names = names.join(first, "comp").select("rep", (F.col("k") - F.col("_k")).alias("block"))
    sides = group.select("id", "comp", "rep")
    lower = off.select("u", "v", F.when(under, F.col("v")).otherwise(F.col("u")).alias("id"))
    every = group.select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), "comp", "rep").unionByName(lower.join(sides, "id").select("u", "v", "comp", "rep"))
    out = written(every.join(names, "rep").select("comp", "block", "u", "v"), "blocks")
    dropped(forest, tree, off, group, ends)
    return out


def articulation_points(g: ScoredGraph) -> DataFrame:
    """(id, n_blocks) of the nodes in more than one block."""
    ends = blocks(g).select("comp", "block", F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_blocks")).where("n_blocks > 1")


def block_cut_tree(g: ScoredGraph) -> DataFrame:
    """(comp, block, cut_id, block_degree): edges of the block-cut tree."""
    ends = written(blocks(g).select("comp", "block", F.explode(F.array("u", "v")).alias("cut_id")).distinct(), "block_ends")
    cut = ends.groupBy("cut_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cut_id")
    shared = ends.join(cut, "cut_id", "left_semi").select("comp", "block", "cut_id")
    size = shared.groupBy("comp", "block").agg(F.count(F.lit(1)).alias("block_degree"))
    return shared.join(size, ["comp", "block"]).select("comp", "block", "cut_id", "block_degree")


def kind(g: ScoredGraph) -> tuple[bool, bool]:
    """(is_forest, is_connected), of components that are found once."""
    n, c = components(g).agg(F.count(F.lit(1)), F.count_if(F.col("id") == F.col("comp"))).first()
    return g.edges.count() == n - c, c <= 1


def is_connected(g: ScoredGraph) -> bool:
    return components(g).select("comp").distinct().limit(2).count() <= 1


def is_forest(g: ScoredGraph) -> bool:
    n, c = components(g).agg(F.count(F.lit(1)), F.count_if(F.col("id") == F.col("comp"))).first()
    return g.edges.count() == n - c
