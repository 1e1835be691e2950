"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned so that the leading dimensions hold most of their length. Exact copies are one
class before anything is compared. Classes are dealt into cells by the signs of leading dimensions: a
pair is compared in the cell of its midpoint, and a vector is sent to every cell where such a midpoint
can lie, so no pair is missed and none counted twice. In a cell, tiles of vectors accumulate products
over the leading dimensions first; the rest of a product is bounded by the vectors' suffix norms, and
a pair (or whole tile) is left as soon as it cannot reach the threshold. Pairs that remain are decided
by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import join_hot
from scorenet.operators.components import connected_components, merge_labels
from scorenet.storage import dropped, written

#: Most vectors that the axes, and the number of signs that make cells, go by; all are compared.
FIT_ROWS, SIGN_ROWS = 100_000, 4_000
CELL_ROWS = 512
TILE_ROWS = 4096
STEP = 8
SLACK = 1e-9
HOT_SHARE = 1000


def leading_axes(unit: np.ndarray) -> np.ndarray:
    """Second moments of unit vectors, to be summed over tasks before the axes are taken."""
    return unit.T @ unit


def as_units(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def reachable_cells(lead: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell of signs that holds a point within ``sqrt(reach)`` of the row."""
    row = np.arange(len(lead))
    cell, spent = np.zeros(len(lead), np.int64), np.zeros(len(lead))
    for k in range(lead.shape[1]):
        x = lead[row, k]
        bit = (x >= 0).astype(np.int64) << k
        over = spent + x * x
        also = np.flatnonzero(over <= reach)
        row, spent = np.r_[row, row[also]], np.r_[spent, over[also]]
        cell = np.r_[cell | bit, cell[also] | (bit[also] ^ (1 << k))]
    return row, cell


def signs_worth(turned: np.ndarray, reach: float, count: int, most: int, cell_rows: int = CELL_ROWS) -> int:
    """How many leading signs make the least work, going by a sample of turned vectors: pairs compared,
    and rows sent to cells, each as costly as comparing it with ``cell_rows`` others. Where components
    are small against the threshold's distance, a row reaches many cells and none are worth having."""
    m = len(turned)
    if m < 2:
        return 0
    best, least = 0, 1.0 + cell_rows / max(1, count)
    for lead in range(1, most + 1):
        row, cell = reachable_cells(turned[:, :lead], reach)
        if len(row) > 64 * m:
            break
        size = np.unique(cell, return_counts=True)[1].astype(float)
        cost = (size * (size - 1)).sum() / (m * (m - 1)) + len(row) / m * cell_rows / max(1, count)
        if cost < least:
            best, least = lead, cost
    return best


def tile_pairs(a: np.ndarray, b: np.ndarray, least: float, step: int = STEP):
    """Arrays (i, j) of rows whose product may reach ``least``; axes in descending weight."""
    d = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    for lo in range(0, len(a), 1024):
        for at in range(0, len(b), 1024):
            x, y = a[lo : lo + 1024], b[at : at + 1024]
            got = x[:, :step] @ y[:, :step].T
            k = min(step, d)
            while True:
                bound = got + np.outer(rest_a[lo : lo + 1024, k], rest_b[at : at + 1024, k]) if k < d else got
                i, j = np.nonzero(bound >= least)
                if not len(i) or k >= d or len(i) < bound.size // 16:
                    break
                got = got + x[:, k : k + step] @ y[:, k : k + step].T
                k = min(k + step, d)
            dot = got[i, j]
            while len(i) and k < d:
                dot = dot + np.einsum("ij,ij->i", x[i, k : k + step], y[j, k : k + step])
                k = min(k + step, d)
                live = dot + (rest_a[lo + i, k] * rest_b[at + j, k] if k < d else 0) >= least
                i, j, dot = i[live], j[live], dot[live]
            if len(i):
                yield lo + i, at + j


def cosine_classes(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with cosine >= ``least``.

    Null, zero and empty vectors, and those that hold null or non-finite components link with nothing:
    no links, their own id as component, kept. Vectors of different lengths don't link; each length that
    there is gets axes and jobs of its own. Repeated vectors link with each other. A null id is kept null
    and lends its class no id; such a row is not kept if linked. An empty table gives an empty result;
    other columns are not read. No pair is ever written: each task returns counts of links and a forest
    of its cell."""
    double = dict(vectors.dtypes)[vec_col] == "array<double>"
    kind = np.float64 if double else np.float32
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>" if double else "array<float>").alias("v"))

    def pack(batches):
        for b in batches:
            held = []
            for v in b.column(1).to_pylist():
                x = None
                if v and None not in v:
                    x = np.array(v, kind)
                    if not (np.isfinite(x).all() and x.any()):
                        x = None
                held.append(None if x is None else x.tobytes())
            keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in held]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], names=["vec_id", "key", "vec"])

    packed = written(rows.mapInArrow(pack, "vec_id long, key binary, vec binary"), "vectors")
    classes = packed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = written(classes, "classes")
    size = np.dtype(kind).itemsize
    lengths = classes.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).orderBy("bytes").collect()  # a row for each length of vectors
    parts = [_known(classes.where(F.octet_length("vec") == r.bytes), r.n, r.bytes // size, kind, least, cell_rows, tile_rows) for r in lengths]
    own = packed.select("vec_id", "key")
    alone = own.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if parts:
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        hot = known.where(F.col("n") >= max(2, sum(r.n for r in lengths) // HOT_SHARE)).drop("n")
        alone = join_hot(own.where("key is not null"), known.drop("n"), "key", hot).select("vec_id", "n_links", "component_id").unionByName(alone)
    return alone.select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def _known(classes: DataFrame, count: int, width: int, kind: type, least: float, cell_rows: int, tile_rows: int) -> DataFrame:
    """(key, n, n_links, component_id) of classes (key, rep, n, vec) of vectors of one length."""
    if count == 1:
        return classes.select("key", "n", (F.col("n") - 1).alias("n_links"), F.col("rep").alias("component_id"))

    def moments(batches):
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                total += leading_axes(as_units(np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, width).astype(float)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    share = min(1.0, FIT_ROWS / max(1, count))
    picked = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").coalesce(8)
    sums = [np.frombuffer(r.m).reshape(width, width) for r in picked.mapInArrow(moments, "m binary").collect()]  # at most 8 rows
    axes = np.ascontiguousarray(np.linalg.eigh(sum(sums, np.zeros((width, width))))[1][:, ::-1])
    reach = (2 - 2 * least) / 4 + SLACK
    some = [r.vec for r in classes.orderBy(F.xxhash64("key"), "key").select("vec").limit(SIGN_ROWS).collect()]  # at most SIGN_ROWS rows
    turned = as_units(np.frombuffer(b"".join(some), kind).reshape(-1, width).astype(float)) @ axes if some else np.zeros((0, width))
    lead = signs_worth(turned, reach, count, min(width, 24, max(0, math.ceil(math.log2(max(1, count) / cell_rows)))), cell_rows)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(-1, width)
            for lo in range(0, len(raw), 2000):
                row, cell = reachable_cells((as_units(raw[lo : lo + 2000].astype(float)) @ axes)[:, :lead], reach)
                out = b.select(["rep", "n", "vec"]).take(pa.array(row + lo))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *out.columns], names=["cell", "rep", "n", "vec"])

    cells = written(classes.where("rep is not null").mapInArrow(deal, "cell long, rep long, n long, vec binary"), "cells")
    sizes = cells.groupBy("cell").count().where(F.col("count") > tile_rows).select("cell", F.ceil(F.col("count") / tile_rows).alias("k"))
    parts = cells.join(sizes, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("rep"), F.col("k")))
    parts = parts.select("cell", "rep", "n", "vec", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("t"))
    parts = parts.select("cell", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), F.when(F.col("s") <= F.col("t"), 0).otherwise(1).alias("side"), "rep", "n", "vec")

    def compare(key, table):
        cell, i, j = (k.as_py() for k in key)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        raw = np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(-1, width).astype(float)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ axes
        side = table.column("side").to_numpy()
        left, right = (np.arange(len(rep)),) * 2 if i == j else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for x, y in tile_pairs(turned[left], turned[right], least - SLACK):
            x, y = left[x], right[y]
            if i == j:
                once = x < y
                x, y = x[once], y[once]
            middle = ((turned[x, :lead] + turned[y, :lead]) >= 0) @ (1 << np.arange(lead, dtype=np.int64)) if lead else np.zeros(len(x), np.int64)
            x, y = x[middle == cell], y[middle == cell]
            sure = np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= least
            x, y = x[sure], y[sure]
            links += np.bincount(x, n[y], len(rep)).astype(np.int64) + np.bincount(y, n[x], len(rep)).astype(np.int64)
            merge_labels(label, x, y)
        some = links > 0
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[label[some]])], names=["rep", "links", "root"])

    # Work goes by pairs, not bytes: a number of partitions of its own keeps few bytes from meeting in one task.
    k = F.ceil(F.col("count") / tile_rows)
    tiles = cells.groupBy("cell").count().agg(F.sum(k * (k + 1) / 2)).first()[0] or 1
    tasks = int(min(max(tiles, 1), 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = parts.repartition(max(tasks, 1), "cell", "i", "j")
    found = written(parts.groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, root long"), "found")
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("rep"), "comp")
    sums_ = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rep", "n").join(sums_, "rep", "left").join(comps, "rep", "left")
    known = known.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    known = written(known, "known")
    dropped(cells, found)
    return known


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Pairwise cosines: for tables of some thousand vectors.
ORACLE = {
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, x) AS (SELECT x, x FROM p UNION SELECT r.id, p.y FROM r JOIN p ON p.x = r.x),
c AS (SELECT id, min(x) AS comp FROM r GROUP BY id), l AS (SELECT x AS id, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(comp, vec_id) AS component_id, coalesce(comp, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN l ON l.id = vec_id
"""
}
