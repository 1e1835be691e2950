"""Exact search over whole networks by waves of blocks.

All leaf blocks of all components are taken at once: what the best set that holds a block's cut node gains
over that node alone is added to its weight by a join, and the block is dropped. Components that are trees
need no search. States of blocks that are not proved within a number of steps are rows of a table; every
round deals them anew over all tasks, with the best values known so far, so one hard block keeps all busy.
"""

from __future__ import annotations

import time
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import ScoredGraph
from scorenet.operators.components import connected_components
from scorenet.operators.ranking import numbered
from scorenet.operators.topology import blocks, components
from scorenet.plans import local
from scorenet.storage import dropped, written

#: States that a task expands of a search in the first round and in later ones, and searches of a round's
#: tasks: rows of one search go to so many slices.
STEPS, MORE_STEPS, SLICES = 2_000, 20_000, 32
#: Nodes from which a block is trimmed and starts from drawn trees.
SMALL_BLOCK, DRAWS = 24, 5
NODE, EDGE, STATE, BEST = range(4)
ROWS = "sid long, comp long, free boolean, kind int, a long, b long, w double, must boolean, inside array<long>, out array<long>, bound double"
SCHEMA = pa.schema([
    ("sid", pa.int64()), ("comp", pa.int64()), ("free", pa.bool_()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64()), ("must", pa.bool_()),
    ("inside", pa.list_(pa.int64())), ("out", pa.list_(pa.int64())), ("bound", pa.float64()),
])
LOW = float("-inf")


def _tables(rows, size: int = 2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _stream(batches):
    for b in batches:
        for i in range(0, b.num_rows, 5000):
            yield from b.slice(i, 5000).to_pylist()


def _told(search: local.Search, states: list, key: tuple, nodes: bool):
    """Rows of a search: its best set, and what is left of it."""
    if search.best_set is not None:
        yield (*key, BEST, None, None, float(search.best), None, sorted(search.best_set), None, None)
    if states and nodes:
        for v, ys in search.adj.items():
            yield (*key, NODE, v, None, float(search.w[v]), v in search.must, None, None, None)
            for y in ys:
                if v < y:
                    yield (*key, EDGE, v, y, None, None, None, None, None)
    for inside, out, total in states:
        bound = search.open(inside, out, total)
        if bound > search.best:
            yield (*key, STATE, None, None, float(total), None, sorted(inside), sorted(out), float(bound))


def _first(steps: int, least: float, rooted: bool, deadline: float):
    """Of each block: the search that is rooted at its cut node (or root), and the one free of it."""

    def rows(batches):
        for sid, part in groupby(_stream(batches), lambda r: r["sid"]):
            w, edges, must, cut, comp = {}, [], set(), None, None
            for r in part:
                comp, cut = r["comp"], r["cut"]
                if r["kind"] == NODE:
                    w[r["a"]] = r["w"]
                    must |= {r["a"]} if r["must"] else set()
                else:
                    edges.append((r["a"], r["b"]))
            adj = local.adjacency(edges, w)
            until = time.monotonic() + max(1.0, deadline / 5)
            large = len(w) >= SMALL_BLOCK
            if large:
                adj = local.trimmed(adj, w, must | ({cut} - {None}), until)
            if not rooted:
                sub = {x: adj[x] - {cut} for x in adj if x != cut}
                search = local.Search(sub, w)
                search.best = least
                if large:
                    value, ids = local.monte_carlo({v: w[v] for v in sub}, [(u, v) for u in sub for v in sub[u] if u < v], seeds=range(DRAWS), deadline=until)
                    if value > search.best and ids and _whole(sub, ids):
                        search.best, search.best_set = value, frozenset(ids)
                order = sorted((v for v in sub if w[v] > 0), key=lambda v: (-w[v], v))
                if order and w[order[0]] > search.best:
                    search.best, search.best_set = w[order[0]], frozenset(order[:1])
                states = [(frozenset([v]), frozenset(order[:k]), w[v]) for k, v in enumerate(order)]
                yield from _told(search, search.work(states[::-1], steps), (2 * sid, comp, True), True)
            root = cut if cut is not None else min(must, default=None)
            if root is not None:
                search = local.Search(adj, w, frozenset(must | {root}))
                first = local.joined(adj, must | {root})
                if search.must <= first:
                    search.best, search.best_set = sum(w[x] for x in first), first
                yield from _told(search, search.work([(frozenset([root]), frozenset(), w[root])], steps), (2 * sid + 1, comp, False), True)

    return lambda batches: _tables(rows(batches))


def _whole(adj, ids) -> bool:
    ids, seen = set(ids), set()
    todo = [min(ids)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += adj[x] & ids
    return seen == ids


def _more(steps: int, deadline: float):
    """Expand the states of each slice of a search, which its nodes and edges come before."""

    def rows(batches):
        for _, part in groupby(_stream(batches), lambda r: (r["sid"], r["slice"])):
            w, edges, must, states, key, best = {}, [], set(), [], None, LOW
            for r in part:
                key = (r["sid"], r["comp"], r["free"])
                if r["kind"] == NODE:
                    w[r["a"]] = r["w"]
                    must |= {r["a"]} if r["must"] else set()
                elif r["kind"] == EDGE:
                    edges.append((r["a"], r["b"]))
                else:
                    states.append((frozenset(r["inside"]), frozenset(r["out"]), r["w"]))
                    best = max(best, r["best"])
            if states:
                search = local.Search(local.adjacency(edges, w), w, must, time.monotonic() + max(0.0, deadline))
                search.best = best
                yield from _told(search, search.work(states, steps), key, False)

    return lambda batches: _tables(rows(batches))


def searched(parts: DataFrame, least: float, rooted: bool, until: float, steps: int, trace=None) -> tuple[DataFrame, DataFrame]:
    """(sid, comp, free, value, up, set): the best of each search of blocks ``parts``, and a bound that
    holds where the time is up; sets that a search starts with and does not beat are null. And the rounds."""
    left = lambda: until - time.monotonic()
    rows = parts.repartition("sid").sortWithinPartitions("sid", "kind").mapInArrow(_first(steps, least, rooted, left()), ROWS)
    rows = written(rows, "searches")
    base, found, open_ = rows.where(F.col("kind") <= EDGE), [rows.where(F.col("kind") == BEST)], rows.where(F.col("kind") == STATE)

    def bests() -> DataFrame:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return every.groupBy("sid", "comp", "free").agg(F.max("w").alias("value"), F.max_by("inside", F.struct("w", -F.size("inside"))).alias("set"))

    while True:
        best = bests().select("sid", "value", "free")
        top = best.where("free").agg(F.max("value")).first()[0]
        floor = F.when(F.col("free"), F.greatest(F.lit(least), F.lit(top if top is not None else LOW))).otherwise(LOW)
        states = open_.join(best.drop("free"), "sid", "left").withColumn("best", F.greatest(F.coalesce("value", F.lit(LOW)), floor)).where("bound > best").drop("value")
        states = written(states.withColumn("slice", F.pmod(F.xxhash64("inside", "out"), F.lit(SLICES)).cast("int")), "states")
        if trace and top is not None:
            trace(top)
        if states.isEmpty() or left() <= 0:
            break
        here = states.select("sid", "slice").distinct()
        nodes = base.join(here, "sid").select(*states.drop("best", "slice").columns, F.lit(None).cast("double").alias("best"), "slice")
        work = nodes.unionByName(states).repartition("sid", "slice").sortWithinPartitions("sid", "slice", "kind", F.col("bound").asc())
        rows = written(work.mapInArrow(_more(MORE_STEPS, left()), ROWS), "expanded")
        found.append(rows.where(F.col("kind") == BEST))
        open_ = rows.where(F.col("kind") == STATE)
    open_ = states.groupBy("sid").agg(F.max("bound").alias("open"))
    out = bests().join(open_, "sid", "full").select("sid", "comp", "free", "value", "set", F.greatest("value", "open").alias("up"))
    return written(out, "block_results"), states


def by_waves(g: ScoredGraph, seconds: float = 10.0, least: float = 0.0, steps: int = STEPS, trace=None, most_waves: int = 100_000) -> DataFrame:
    """(comp, value, bound, id): the best connected set of each component of ``g`` that comes to more than
    ``least`` and than what other components have; others may have none, or less than their best. With
    roots, which must all lie in one component, the set that holds them. ``id`` is null where no such set
    was found. After ``seconds`` no search gets more than its first ``steps``; then sets are connected and
    bounds hold."""
    until = time.monotonic() + seconds
    rooted = bool(g.nodes.where("is_root").limit(1).count())
    b = blocks(g)
    names = numbered(b.select("comp", "block").distinct(), "comp", "block").withColumnRenamed("k", "sid")
    edges = written(b.join(names, ["comp", "block"]).select("sid", "comp", "u", "v"), "block_edges")
    members = written(edges.select("sid", "comp", F.explode(F.array("u", "v")).alias("id")).distinct(), "block_members")
    lone = components(g).join(members.select("id"), "id", "left_anti").join(g.nodes, "id")
    weights = written(g.nodes.select("id", F.col("score").alias("w"), F.col("is_root").alias("must")), "weights")
    answers = [lone.select("comp", F.col("score").alias("value"), F.col("score").alias("up"), F.array("id").alias("set"), F.lit(0).alias("wave")).where(F.lit(rooted) | (F.col("value") > least))]
    todo = written(members.select("sid").distinct(), "blocks_to_do")
    owners, slack, best, wave = [], [], least, 0
    top_block = members.join(g.nodes.where("is_root").select("id"), "id", "left_semi").agg(F.min_by("sid", F.struct("id", "sid"))).first()[0] if rooted else None
    while not todo.isEmpty():
        wave += 1
        if wave > most_waves:
            raise RuntimeError("the waves did not end")
        now = members.join(todo, "sid")
        shared = now.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        cuts = now.join(shared, "id", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("cut"))
        leaf = todo.join(cuts, "sid", "left").where("n is null or n = 1").select("sid", "cut")
        if rooted:  # the block of the least root comes last, as no cut node need be in the set
            leaf = leaf.where((F.col("sid") != top_block) | F.col("cut").isNull())
        leaf = written(leaf, "leaf_blocks")
        nodes = now.join(leaf, "sid").join(weights, "id").select("sid", "comp", "cut", F.lit(NODE).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "w", "must")
        lines = edges.join(leaf, "sid").select("sid", "comp", "cut", F.lit(EDGE).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("boolean").alias("must"))
        got, _ = searched(nodes.unionByName(lines), best, rooted, until, steps, trace)
        last = leaf.where("cut is null").select((2 * F.col("sid") + 1).alias("sid"))
        whole = got.where("free") if not rooted else got.join(last, "sid", "left_semi")
        answers.append(whole.where("set is not null or up is not null").select("comp", "value", "up", "set", F.lit(wave).alias("wave")))
        hung = got.where("not free").join(leaf.where("cut is not null").select((2 * F.col("sid") + 1).alias("sid"), "cut"), "sid")
        had = weights.select(F.col("id").alias("cut"), F.col("w").alias("own"))
        hung = written(hung.join(had, "cut").select("comp", "cut", (F.col("value") - F.col("own")).alias("gain"), (F.col("up") - F.col("value")).alias("slack"), "set"), "gains")
        owners.append(hung.select("cut", F.explode("set").alias("id"), F.lit(wave).alias("wave")).where("id <> cut"))
        slack.append(hung.select("comp", "slack"))
        gain = hung.groupBy(F.col("cut").alias("id")).agg(F.sum("gain").alias("gain"))
        after = weights.join(gain, "id", "left").withColumn("w", F.col("w") + F.coalesce("gain", F.lit(0.0))).select("id", "w", "must")
        if rooted:
            held = hung.select("cut", F.explode("set").alias("id")).join(weights.where("must").select("id"), "id", "left_semi").select("cut").distinct()
            after = after.join(held.select(F.col("cut").alias("id"), F.lit(True).alias("h")), "id", "left").select("id", "w", (F.col("must") | F.coalesce("h", F.lit(False))).alias("must"))
        after = written(after, "weights")
        rest = written(todo.join(leaf, "sid", "left_anti"), "blocks_to_do")
        # A cut node whose blocks have all gone at once stands for its component.
        ended = hung.select("comp", "cut").distinct().join(members.join(rest, "sid").select("comp").distinct(), "comp", "left_anti")
        alone = ended.join(after, F.col("cut") == F.col("id")).select("comp", F.col("w").alias("value"), F.col("w").alias("up"), F.array("cut").alias("set"), F.lit(wave + 1).alias("wave"))
        answers.append(written(alone.where(F.lit(rooted) | (F.col("value") > best)), "ended"))
        if not rooted:
            top = answers[-1].agg(F.max("value")).first()[0], answers[-2].agg(F.max("value")).first()[0]
            best = max([best, *(x for x in top if x is not None)])
        weights, todo = after, rest
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    loose = slack[0] if slack else None
    for s in slack[1:]:
        loose = loose.unionByName(s)
    each = every.groupBy("comp").agg(F.max("value").alias("value"), F.max_by("set", F.struct("value", -F.col("wave"))).alias("set"), F.max_by("wave", F.struct("value", -F.col("wave"))).alias("wave"), F.max("up").alias("up"))
    if loose is not None:
        each = each.join(loose.groupBy("comp").agg(F.sum("slack").alias("slack")), "comp", "left").withColumn("up", F.col("up") + F.coalesce("slack", F.lit(0.0)))
    each = written(each.select("comp", "value", "set", "wave", F.greatest("up", "value").alias("bound")), "component_results")
    # What cut nodes of a set carry, from waves before it was found.
    ids = each.select("comp", "wave", F.explode("set").alias("id"))
    hang = owners[0] if owners else None
    for o in owners[1:]:
        hang = hang.unionByName(o)
    out = ids.select("comp", "id")
    if hang is not None:
        where = members.select("comp", "id").distinct().join(each.select("comp", "wave"), "comp")
        live = hang.withColumnRenamed("wave", "w").join(where.select("id", F.col("wave")), "id").where("w < wave").select(F.col("id").alias("u"), F.col("cut").alias("v"))
        tree = written(connected_components(live), "carried").withColumnRenamed("comp", "top")
        mine = tree.join(ids.select("comp", "id"), "id").select("comp", "top").distinct()
        out = out.unionByName(tree.join(mine, "top").select("comp", "id")).distinct()
    done = each.select("comp", "value", "bound").join(out, "comp", "left")
    result = written(done, "by_waves")
    dropped(edges, members)
    return result
