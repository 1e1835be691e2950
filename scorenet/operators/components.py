"""Connected components by rounds that contract the network.

In a round every node points at one of itself and its neighbours by a hash drawn anew, and edges join what
their ends point at. About half the nodes go, and components that have come down to one node have no edge
left, so all rounds together move little more than the first. Each task first contracts its own edges to a
forest; a task holds a bounded number of edges. Once no more than ``small`` edges are left, one task ends
the job; that size is counted, not assumed. The pointers of all rounds, followed to their ends, tell the
components, which are then named by their least node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.storage import dropped, written


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i] for all i; a label is the least index of its set.

    ``label`` must itself be such a labelling; it is changed in place and returned."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
    return label


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its component, and that least node."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = merge_labels(np.arange(len(ids)), at[: len(u)], at[len(u) :])
    low = ids[label]
    other = low != ids
    return ids[other], low[other]


#: Edges that a task holds at once; from half as many in its forest, that goes on and the next begins.
HELD = 300_000


def _contract(batches, most: int | None = HELD):
    u = v = np.zeros(0, np.int64)
    held: list = []
    n = 0

    def fold():
        nonlocal u, v, held, n
        u = np.concatenate([u, *(x for x, _ in held)])
        v = np.concatenate([v, *(y for _, y in held)])
        u, v = forest(u, v)
        held, n = [], 0

    def out():
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], names=["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if most is not None and n + len(u) >= most:
            fold()
            if len(u) > most // 2:
                yield from out()
                u = v = np.zeros(0, np.int64)
    fold()
    yield from out()


def _whole(batches):
    return _contract(batches, None)


def contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Edges (u, v) of the same components, at most one for each node and ``HELD`` edges of a task; of a
    few edges in one task one for each node, if ``whole``."""
    return edges.select("u", "v").mapInArrow(_whole if whole else _contract, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round (Kiveris et al., 2014), which keeps all nodes."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _pointed(edges: DataFrame, k: int) -> DataFrame:
    """(id, to) for every node of ``edges``. Round ``k`` names nodes anew by a hash, which for single longs
    is one to one, and ``to`` is the least name among a node and its neighbours. So a chain in the order
    of its ids is no worse than any other."""
    u, v = F.xxhash64("u", F.lit(k)), F.xxhash64("v", F.lit(k))
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.least(u, v).alias("to")), F.struct(F.col("v").alias("id"), F.least(u, v).alias("to")))))
    return ends.groupBy("id").agg(F.min("to").alias("to"))


def connected_components(edges: DataFrame, small: int = 200_000, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of ``edges`` (u long, v long); comp is the least id reachable.

    Null ends and self-loops are left out, so a node that only they name has no row. Repeated and
    reversed edges count once. An empty input gives an empty result. More than ``most_rounds``
    rounds raise an error rather than return a partial answer."""
    clean = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = written(contracted(clean), "edges")
    steps = []
    for k in range(most_rounds):
        n = now.count()
        if n <= small:
            break
        to = written(_pointed(now, k), "pointed")
        after = now.join(to.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(to.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        after = written(contracted(after.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
        dropped(now)
        steps.append(to)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    last = written(contracted(now.coalesce(1), True), "forest") if n else now
    dropped(*([now] if last is not now else []))
    if not steps:
        return last.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(last.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
    # Names are of a round: an end is a name and its round.
    ends = last.select(F.col("u").alias("to"), F.col("v").alias("end"), F.lit(len(steps)).alias("at"))
    for k, to in reversed([*enumerate(steps, 1)]):  # a node without an edge in the next round ends there
        ends = to.join(ends, "to", "left").select(F.col("id").alias("to"), F.coalesce("end", "to").alias("end"), F.coalesce("at", F.lit(k)).alias("at"))
    ends = written(ends.withColumnRenamed("to", "id"), "ends")
    dropped(last, *steps)
    low = ends.groupBy("end", "at").agg(F.min("id").alias("comp"))
    return ends.join(low, ["end", "at"]).select("id", "comp")
