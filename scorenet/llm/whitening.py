"""Embedding whitening: principal components of a table of vectors, each scaled to variance one.

Entries become whole numbers, so the first pass sums them exactly and in any order; the mean is a ratio
of integers. The second pass centres every vector by exact differences and sums outer products, one
matrix product a batch; matrices of tasks are merged by treeAggregate. LAPACK's symmetric solver gives the
components on the driver, and the projection (width x components) is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.vector_rows import known_vectors

#: Whole steps to one unit of an entry, and what is added to them.
STEPS, SHIFT = 64, 1_000_000
#: Entries must lie below this, so that the sums of a batch are exact in 64 bits.
LARGEST = 2.0**31
COMPONENTS = 32

SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def as_steps(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, as 64-bit integers."""
    if values.size and np.abs(values).max() >= LARGEST:
        raise ValueError(f"entries of {LARGEST:g} or more can't be whitened exactly")
    return np.floor(STEPS * values).astype(np.int64) + SHIFT


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S for each entry, exact: 64-bit integers, or Python's where those could run over."""
    top = max([abs(int(x.max())), abs(int(x.min()))]) if x.size else 0
    if n * top + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> pa.Array:
    """The sum of squares of each row as decimal(38,0), exact; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    if d.dtype != object and (not d.size or d.shape[1] * int(np.abs(d).max()) ** 2 < 2**62):
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(kind)
    total = [sum(int(x) * int(x) for x in row) for row in d]
    return pa.array([t if t < 10**38 else None for t in total], kind)


def merged(a: tuple, b: tuple) -> tuple:
    """(count, means, centred outer products) of two sets of rows together."""
    (n, m, s), (k, p, t) = a, b
    if not n or not k:
        return b if k else a
    gap = p - m
    return n + k, m + gap * (k / (n + k)), s + t + np.outer(gap, gap) * (n * k / (n + k))


def step_sums(rows: DataFrame) -> list[tuple[int, int, list[int]]]:
    """(width, number of vectors, exact sums of their steps) of each width that there is: a row for each
    dimension reaches the driver."""

    def add(batches):
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for width, at, values in known_vectors(b.column(0)):
                n, sums = held.get(width, (0, [0] * width))
                held[width] = (n + len(at), [s + t for s, t in zip(sums, as_steps(values).sum(axis=0).tolist(), strict=True)])
        out = [(w, k, n, s) for w, (n, sums) in held.items() for k, s in enumerate(sums)]
        kinds = pa.schema([("width", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], schema=kinds)

    each = rows.select("v").mapInArrow(add, "width int, k int, n long, s decimal(38,0)")
    found = each.groupBy("width", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("width", "k").collect()
    widths = {r.width: r.n for r in found}
    return [(w, n, [int(r.s) for r in found if r.width == w]) for w, n in widths.items()]


def tree_sum(rows: DataFrame, of_batch, zero, add):
    """``of_batch`` of each batch's vectors, merged by ``add`` within tasks and then by treeAggregate."""

    def run(batches):
        total = zero
        for b in batches:
            for width, _, values in known_vectors(b.column(0)):
                total = add(total, of_batch(width, values))
        parts = total if isinstance(total, tuple) else (total,)
        yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(p, float).tobytes() for p in parts]], pa.list_(pa.binary()))], names=["m"])

    shapes = [np.shape(p) for p in (zero if isinstance(zero, tuple) else (zero,))]

    def read(row):
        got = tuple(np.frombuffer(m).reshape(s) if s else float(np.frombuffer(m)[0]) for m, s in zip(row.m, shapes, strict=True))
        return got if isinstance(zero, tuple) else got[0]

    return rows.select("v").mapInArrow(run, "m array<binary>").rdd.map(read).treeAggregate(zero, add, add)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each vector and component up to ``components``: vec_id, component, n, deviation, whitened,
    explained, identity_error, as ``SCHEMA`` has them.

    ``n`` counts the fit list, which is every vector that is not null and holds neither null nor
    non-finite entries; others have no rows. With x = floor(64 c) + 1000000 for an entry c and S the sums
    of x, ``deviation`` is the sum of (n x - S)^2, exact (null beyond 38 digits); ``whitened`` is x - S/n on
    the unit eigenvector of the covariance (divisor n), over the root of its eigenvalue; ``explained`` is
    the eigenvalue's share of all; ``identity_error`` the largest absolute entry of the whitened rows'
    covariance less the identity. Components come by falling eigenvalue; of a component's two signs the one
    whose largest entry is positive is taken.

    Vectors of several lengths are fits of their own. A component without variance (rank too low, a single
    vector, repeats of one) has null as ``whitened`` and is left out of ``identity_error``, which is null if
    there is no other; ``explained`` is null if nothing varies. Repeated rows and ids count each time, a
    null id stays null. Empty vectors have no components, an empty table no rows. Entries of 2^31 or more
    raise an error. Other columns are not read."""
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    spark = vectors.sparkSession
    fits: dict[int, tuple] = {}
    for width, n, sums in step_sums(rows):
        own = rows.where(F.size("v") == width)

        def outer(w, values, n=n, sums=sums):
            y = (differences(as_steps(values), n, sums) / n).astype(float)
            return y.T @ y

        v = tree_sum(own, outer, np.zeros((width, width)), np.add) / n
        e, axes = np.linalg.eigh(v)
        e, axes = e[::-1], axes[:, ::-1]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
        k = min(components, width)
        rank = int((e > max(e[0], 0.0) * width * np.finfo(float).eps).sum())
        live = min(k, rank)
        project = axes[:, :live] / np.sqrt(e[:live])
        fits[width] = (n, sums, project, (np.maximum(e[:k], 0) / np.trace(v)).tolist() if rank else [None] * k)

    sent = spark.sparkContext.broadcast(fits)

    def projected(values, fit):
        d = differences(as_steps(values), fit[0], fit[1])
        return d, (d / fit[0]).astype(float) @ fit[2]

    errors: dict[int, float | None] = {}
    for width, fit in fits.items():
        live = fit[2].shape[1]

        def moments(w, values):
            _, z = projected(values, sent.value[w])
            mean = z.mean(axis=0)
            return float(len(z)), mean, (z - mean).T @ (z - mean)

        if live:
            count, _, square = tree_sum(rows.where(F.size("v") == width), moments, (0.0, np.zeros(live), np.zeros((live, live))), merged)
            errors[width] = float(np.abs(square / count - np.eye(live)).max())
        else:
            errors[width] = None

    def run(batches):
        for b in batches:
            for width, at, values in known_vectors(b.column(1)):
                if not width:
                    continue
                n, _, project, explained = sent.value[width]
                d, z = projected(values, sent.value[width])
                k, live, m = len(explained), project.shape[1], len(at)
                scores = pa.array(np.c_[z, np.zeros((m, k - live))].ravel(), mask=np.tile(np.arange(k) >= live, m))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        deviations(d).take(each), scores, pa.array(explained * m, pa.float64()), pa.array([errors[width]] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
