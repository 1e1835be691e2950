"""Rooted forests as tables: an Euler tour by pointer doubling, and values of subtrees by contraction.

Both take a number of rounds that grows with the logarithm of the nodes, whatever the shape of the trees:
a path of a million nodes is no worse than a star. Once no more than ``small`` rows are left, which is
counted, one task ends the job.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.graph import symmetric
from scorenet.operators.components import connected_components
from scorenet.operators.ranking import numbered
from scorenet.storage import dropped, written

SMALL = 200_000
#: Places before and after all others, of a root.
BEFORE, AFTER = -(1 << 62), 1 << 62


def _double(batches):
    """Distances to the ends of lists whose members are numbered 1, 2, ..."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    k = np.concatenate([b.column("k").to_numpy() for b in rows])
    to = np.concatenate([b.column("to").fill_null(0).to_numpy() for b in rows])
    order = np.argsort(k)
    back = np.searchsorted(k[order], to)  # where each one's next stands
    at = np.where(to > 0, order[np.minimum(back, len(k) - 1)], len(k))
    at = np.r_[at, len(k)]
    d = np.r_[np.concatenate([b.column("d").to_numpy() for b in rows]), 0]
    while (at < len(k)).any():
        d, at = d + d[at], at[at]
    for i in range(0, len(k), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(np.zeros(len(k[i : i + 100_000]), np.int64)), pa.array(d[: len(k)][i : i + 100_000])], names=["k", "to", "d"])


def list_distances(lists: DataFrame, small: int = SMALL, most_rounds: int = 64) -> DataFrame:
    """(k, d) from lists (k, to), each member numbered by its own k and pointing at the next, null at the
    end: how many steps it is from the end. Each round doubles every pointer's reach, by one join."""
    now = written(lists.select("k", "to", F.col("to").isNotNull().cast("long").alias("d")), "pointers")
    for _ in range(most_rounds):
        left, n = now.agg(F.count("to"), F.count(F.lit(1))).first()
        if not left:
            return now.select("k", "d")
        if n <= small:
            after = written(now.coalesce(1).mapInArrow(_double, "k long, to long, d long"), "pointers")
            dropped(now)
            return after.select("k", "d")
        ahead = now.select(F.col("k").alias("_k"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        after = now.join(ahead, now["to"] == ahead["_k"], "left").select("k", F.col("_to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"))
        after = written(after, "pointers")
        dropped(now)
        now = after
    raise RuntimeError("the lists did not end: they hold a circle")


def rooted(forest: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, parent, root, first, last) of the nodes that edges ``forest`` (u, v) name, which must hold no
    circle. A tree's root is its least id and has no parent. ``first`` and ``last`` are places of a walk
    around the tree: x lies at or below v just if first(v) <= first(x) <= last(v) and the roots are one."""
    arcs = symmetric(forest).select("id", "nbr")
    arcs = written(numbered(arcs, "id", "nbr"), "arcs")
    comp = written(connected_components(forest), "tree_roots")
    turn = arcs.groupBy("id").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    turn = turn.join(comp, "id").select(F.col("id").alias("at"), "lo", "hi", (F.col("id") == F.col("comp")).alias("is_root"))
    back = arcs.select(F.col("id").alias("nbr"), F.col("nbr").alias("id"), F.col("k").alias("twin"))
    both = arcs.join(back, ["id", "nbr"]).join(turn, F.col("nbr") == F.col("at"))
    around = F.when(F.col("twin") < F.col("hi"), F.col("twin") + 1).when(~F.col("is_root"), F.col("lo"))
    far = list_distances(both.select("k", around.alias("to")), small)
    placed = arcs.join(far, "k").select("id", "nbr", (-F.col("d")).alias("t"))
    edge = placed.groupBy(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v")).agg(F.min(F.struct("t", "id", "nbr")).alias("down"), F.max("t").alias("last"))
    below = edge.select(F.col("down.nbr").alias("id"), F.col("down.id").alias("parent"), F.col("down.t").alias("first"), "last")
    below = below.join(comp.withColumnRenamed("comp", "root"), "id").select("id", "parent", "root", "first", "last")
    tops = comp.where("id = comp").select("id", F.lit(None).cast("long").alias("parent"), F.col("comp").alias("root"), F.lit(BEFORE).alias("first"), F.lit(AFTER).alias("last"))
    out = written(below.unionByName(tops), "rooted")
    dropped(arcs, comp)
    return out


class Gain:
    """A node's value is its own and its children's, as far as these are positive."""

    floor = 0

    @staticmethod
    def gathered(column):
        return F.sum(column)

    @staticmethod
    def plus(own, more):
        return own + F.coalesce(more, F.lit(0))

    @staticmethod
    def through(lo_v, d_v, own_v, lo_u, d_u):
        """The way x -> max(lo, x + d) of a child u through its parent v, as one such way."""
        return F.greatest(lo_v, own_v + d_v + lo_u), d_u + own_v + d_v

    @staticmethod
    def folded(own, parts):
        return own + sum(parts)


class Most:
    """A node's value is the greatest among its own and its children's."""

    floor = None

    @staticmethod
    def gathered(column):
        return F.max(column)

    @staticmethod
    def plus(own, more):
        return F.greatest(own, more)  # leaves out nulls

    @staticmethod
    def through(lo_v, d_v, own_v, lo_u, d_u):
        return F.greatest(lo_v, own_v + d_v, lo_u + d_v), d_u + d_v

    @staticmethod
    def folded(own, parts):
        return max([own, *parts])


def subtree_values(tree: DataFrame, columns: list[str], rule: type = Gain, small: int = SMALL, most_rounds: int = 400) -> DataFrame:
    """(id, and each of ``columns``): values of the nodes of rooted trees ``tree`` (id, parent, columns),
    parents null at roots, by ``rule`` from their own values and their children's.

    Rounds contract the trees: leaves hand their values to their parents and go; of nodes with one child,
    a chosen part with no two in a row goes too, and the child is told what its value will have become on
    the way to the next ancestor. Rounds backward give those that went their values. A node that no root
    reaches raises ``ValueError``; a parent that is no node counts as none."""
    kinds = dict(tree.dtypes)
    state = [*columns, *(f"lo_{c}" for c in columns), *(f"d_{c}" for c in columns)]
    start = [F.lit(rule.floor).cast(kinds[c]).alias(f"lo_{c}") for c in columns] + [F.lit(0).cast(kinds[c]).alias(f"d_{c}") for c in columns]
    known = tree.select(F.col("id").alias("parent"))
    rows = tree.select("id", "parent", *columns).join(known.select("parent", F.lit(True).alias("_k")), "parent", "left")
    live = written(rows.select("id", F.when(F.col("_k"), F.col("parent")).alias("parent"), *columns, *start), "tree")
    steps: list[tuple[DataFrame, DataFrame]] = []
    n = live.count()
    for k in range(most_rounds):
        if n <= small:
            break
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
        marked = written(live.join(kids, F.col("id") == F.col("_p"), "left").drop("_p"), "marked")
        leaves = marked.where("n is null")
        given = [rule.gathered(F.greatest(F.col(f"lo_{c}"), F.col(c) + F.col(f"d_{c}"))).alias(f"g_{c}") for c in columns]
        handed = leaves.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("m"), *given)
        inner = marked.where("n is not null").join(handed, F.col("id") == F.col("_p"), "left")
        inner = inner.select("id", "parent", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), *(rule.plus(F.col(c), F.col(f"g_{c}")).alias(c) for c in columns), *state[len(columns) :])
        one = (F.col("n") == 1) & F.col("parent").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0)
        inner = written(inner.withColumn("goes", one), "inner")
        v = inner.where("goes").select(F.col("id").alias("v"), F.col("parent").alias("above"), *(F.col(c).alias(f"v_{c}") for c in state))
        cut = written(inner.where("not goes").join(v, F.col("parent") == F.col("v")).select("v", "above", F.col("id").alias("u"), *(f"v_{c}" for c in state), *(F.col(c).alias(f"u_{c}") for c in state[len(columns) :])), "cut")
        new = []
        for c in columns:
            lo, d = rule.through(F.col(f"v_lo_{c}"), F.col(f"v_d_{c}"), F.col(f"v_{c}"), F.col(f"u_lo_{c}"), F.col(f"u_d_{c}"))
            new += [lo.alias(f"n_lo_{c}"), d.alias(f"n_d_{c}")]
        moved = cut.select(F.col("u").alias("id"), "above", *new)
        left = inner.join(cut.select(F.col("v").alias("id")), "id", "left_anti").join(moved, "id", "left")
        after = left.select("id", F.coalesce("above", "parent").alias("parent"), *columns, *(F.when(F.col("above").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in state[len(columns) :]))
        after = written(after, "tree")
        steps.append((leaves.select("id", *columns), cut))
        dropped(live, inner)
        live, n = after, after.count()
    else:
        raise ValueError("not a forest of rooted trees")
    values = written(live.coalesce(1).mapInArrow(_last(columns, rule), live.select("id", *columns).schema), "values") if n else live.select("id", *columns)
    for leaves, cut in reversed(steps):
        told = cut.join(values.withColumnsRenamed({"id": "u", **{c: f"x_{c}" for c in columns}}), "u")
        told = told.select(F.col("v").alias("id"), *(rule.plus(F.col(f"v_{c}"), F.greatest(F.col(f"u_lo_{c}"), F.col(f"x_{c}") + F.col(f"u_d_{c}"))).alias(c) for c in columns))
        after = written(values.unionByName(leaves).unionByName(told), "values")
        dropped(values)
        values = after
    return values


def _last(columns: list[str], rule: type):
    """Values of the nodes that are left, in one task: children before parents."""

    def run(batches):
        rows = {}
        schema = None
        for b in batches:
            schema = b.schema
            for r in b.to_pylist():
                rows[r["id"]] = r
        kids, waiting = defaultdict(list), defaultdict(int)
        for r in rows.values():
            if r["parent"] is not None:
                waiting[r["parent"]] += 1
        todo = [i for i in rows if not waiting[i]]
        value: dict = {}
        while todo:
            i = todo.pop()
            r = rows[i]
            got = kids.pop(i, [])
            value[i] = [rule.folded(r[c], [g[j] for g in got]) for j, c in enumerate(columns)]
            if r["parent"] is not None:
                way = [r[f"lo_{c}"] for c in columns], [r[f"d_{c}"] for c in columns]
                kids[r["parent"]].append([x + d if lo is None else max(lo, x + d) for x, lo, d in zip(value[i], *way, strict=True)])
                waiting[r["parent"]] -= 1
                if not waiting[r["parent"]]:
                    todo.append(r["parent"])
        if len(value) < len(rows):
            raise ValueError("not a forest of rooted trees")
        ids = list(value)
        for lo in range(0, len(ids), 50_000):
            some = ids[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([value[i][j] for i in some], schema.field(c).type) for j, c in enumerate(columns))], names=["id", *columns])

    return run
