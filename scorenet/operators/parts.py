"""Networks of many components: small ones go whole to a task, many to each; large ones stay tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.operators.components import connected_components
from scorenet.storage import written

#: Most edges of a component that one task works on whole, and rows of components that it takes at once.
WHOLE, AT_ONCE = 20_000, 50_000


def in_parts(edges: DataFrame, whole: int = WHOLE) -> tuple[DataFrame, DataFrame, bool]:
    """``edges`` (u, v) with ``comp``, the least id of their component, for components of at most ``whole``
    edges; those of the others as they came; and whether there are others."""
    comp = written(connected_components(edges), "parts").select(F.col("id").alias("u"), "comp")
    rows = written(edges.join(comp, "u"), "part_edges")
    large = written(rows.groupBy("comp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("comp"), "large_parts")
    if large.isEmpty():
        return rows, edges.limit(0), False
    large = F.broadcast(large)  # a row for each ``whole`` edges at most
    return rows.join(large, "comp", "left_anti"), rows.join(large, "comp", "left_semi").select(*edges.columns), True


def streamed(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, key: str = "comp", dealt: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """``run`` over tables of whole groups of ``key`` (long) together; no group lies in two of them. ``dealt``
    rows come sorted by it, each group in one task; others are also sorted by ``then``."""

    def portions(batches):
        held, n, full = [], 0, AT_ONCE
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= full:
                t = pa.Table.from_batches(held)
                keys = t.column(key).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from run(t.slice(0, cut)).to_batches()
                    held = t.slice(cut).combine_chunks().to_batches()
                    n -= cut
                full = max(AT_ONCE, 2 * n)  # of a group that is larger
        if n:
            yield from run(pa.Table.from_batches(held)).to_batches()

    if not dealt:
        rows = rows.repartition(key).sortWithinPartitions(key, *then)
    return rows.mapInArrow(portions, schema)
