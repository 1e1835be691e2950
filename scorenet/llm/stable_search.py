"""Approximate nearest neighbours by stable projections and a kd-tree.

Nearness is the inner product. Candidates get one more component that brings all to the greatest length
there is, queries are scaled to it, and the largest product is then the least distance. Both are projected
on a few Gaussian directions: the projected distance, squared, is the true one times a chi-square variable
of as many degrees of freedom. So once the k-th distance found is d, a neighbour that is nearer has its
projection within d times the root of a chi-square quantile, but for one in fifty; all beyond need not be
looked at, and the search stops when nothing nearer in projection is left.

Every vector is in the index: cells of a kd-tree whose planes a bounded sample sets, each cell in pages of
bounded size, each page a kd-tree of buckets. Equal vectors are one entry. Blocks of queries search their
own cell first, which gives d; then each goes to the cells that its balls reach, and there from bucket to
bucket, the nearest first, verifying by products of the original vectors while d shrinks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import join_hot
from scorenet.llm.vector_rows import known_vectors
from scorenet.storage import dropped, written

#: Projected dimensions (even), and the chance that the stopping test leaves a true neighbour in.
DIMS, CONFIDENCE = 12, 0.98
#: Most vectors that the planes of the cells go by; all are in the index. Most cells.
FIT_ROWS, MOST_CELLS = 100_000, 4096
#: Entries of a page and of a bucket; queries of a block, blocks of a group.
PAGE, BUCKET, BLOCK, TOGETHER = 4096, 64, 256, 16
HOT_SHARE = 1000
SPARE = 8
ENTRY = "key binary, vec binary, ids array<long>, asked boolean, n long"
PAGES = "cell long, sub long, vecs binary, ends binary, ids binary, buckets binary, lo binary, hi binary"
ASKED = "block long, home long, keys binary, n binary, vecs binary"
LIST = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


def chi_square_quantile(p: float, dims: int) -> float:
    """x such that a chi-square variable of ``dims`` (even) degrees of freedom lies under it with chance p."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1000.0 + 10 * dims
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(width + 1, dims))


def projected(x: np.ndarray, axes: np.ndarray, longest: float, asked: bool) -> np.ndarray:
    """Projections of candidates, lengthened to ``longest``, or of queries, scaled to it."""
    norm = np.linalg.norm(x, axis=1)
    if asked:
        return (x * (longest / norm)[:, None]) @ axes[:-1]
    return x @ axes[:-1] + np.sqrt(np.maximum(longest**2 - norm**2, 0))[:, None] * axes[-1]


def planes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and place of each inner node's plane, of a complete tree in heap order."""
    dim, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    held = {0: points}
    for node in range(2**depth - 1):
        own = held.pop(node)
        if len(own):
            dim[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            at[node] = np.median(own[:, dim[node]])
        left = own[:, dim[node]] <= at[node]
        held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
    return dim, at


def cells_of(points: np.ndarray, dim: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(dim) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dim[node]] > at[node])
    return node - len(dim)


def cell_boxes(dim: np.ndarray, at: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest place of each cell, without end where no plane stands."""
    lo, hi = np.full((2 * len(dim) + 1, dims), -np.inf), np.full((2 * len(dim) + 1, dims), np.inf)
    for node in range(len(dim)):
        for child in (2 * node + 1, 2 * node + 2):
            lo[child], hi[child] = lo[node], hi[node]
        hi[2 * node + 1, dim[node]] = np.minimum(hi[node, dim[node]], at[node])
        lo[2 * node + 2, dim[node]] = np.maximum(lo[node, dim[node]], at[node])
    return lo[len(dim) :], hi[len(dim) :]


def box_distances(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(lo)))
    for k in range(points.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, k] - points[:, k, None], points[:, k, None] - hi[None, :, k]), 0)
        out += gap * gap
    return out


def bucket_order(points: np.ndarray, most: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of a kd-tree's leaves, where the leaves end)."""
    out, ends, stack = [], [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            out.append(rows)
            ends.append((ends[-1] if ends else 0) + len(rows))
            continue
        own = points[rows]
        k = np.argmax(own.max(axis=0) - own.min(axis=0))
        order = rows[np.argsort(own[:, k], kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.concatenate(out), np.array(ends, np.int64)


def same(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class Page:
    """A page's entries in the order of its buckets."""

    def __init__(self, row: dict, kind: type, width: int, dims: int):
        self.vecs = np.frombuffer(row["vecs"], kind).reshape(-1, width).astype(float)
        self.ends, self.ids, self.buckets = (np.frombuffer(row[c], np.int64) for c in ("ends", "ids", "buckets"))
        self.lo, self.hi = (np.frombuffer(row[c]).reshape(-1, dims) for c in ("lo", "hi"))

    def search(self, asked: np.ndarray, points: np.ndarray, floor: np.ndarray, k: int, longest: float, quantile: float):
        """(query, score, id) arrays of what may be among the ``k`` best of a query: scores not under
        ``floor``. Buckets are taken the nearest first; a query is done with those beyond its ball."""
        n = len(asked)
        far = box_distances(points, self.lo, self.hi)
        scale = longest / np.linalg.norm(asked, axis=1)
        top, where = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        floor = floor.copy()
        for b in np.argsort(far.mean(axis=0), kind="stable").tolist():
            first = int(self.buckets[b - 1]) if b else 0
            reach = quantile * np.maximum(2 * longest**2 - 2 * floor * scale, 0)
            live = np.flatnonzero(far[:, b] <= reach * (1 + 1e-9))
            if not len(live):
                continue
            got = asked[live] @ self.vecs[first : int(self.buckets[b])].T
            better = (got >= floor[live, None] - 1e-9 * np.abs(floor[live, None])).any(axis=1)
            if not better.any():
                continue
            live, got = live[better], got[better]
            both = np.c_[top[live], got]
            at = np.c_[where[live], np.broadcast_to(np.arange(first, first + got.shape[1]), got.shape)]
            pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
            top[live], where[live] = np.take_along_axis(both, pick, 1), np.take_along_axis(at, pick, 1)
            floor[live] = np.maximum(floor[live], np.partition(top[live], SPARE, axis=1)[:, SPARE])
        q, j = np.nonzero(top > -np.inf)
        entry = where[q, j]
        score = (asked[q] * self.vecs[entry]).sum(axis=1)  # the same for a pair wherever it stands
        own = score >= floor[q] - 1e-9 * np.abs(floor[q])
        q, entry, score = q[own], entry[own], score[own]
        begin = np.r_[0, self.ends[:-1]][entry]
        size = self.ends[entry] - begin
        each = np.repeat(np.arange(len(q)), size)
        return q[each], score[each], self.ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(each))]


def best_of(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, ties to the smaller id, in order; a pair found twice counts once."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])] if len(q) else np.zeros(0, bool)
    q, score, ids = q[new], score[new], ids[new]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], score[keep], ids[keep]


def _found(rows: Iterator[tuple]) -> pa.Table:
    rows = list(rows)
    names = ["block", "q", "score", "id"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=names)


FOUND = "block long, q binary, score binary, id binary"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = 7, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` other
    rows found with the largest inner products, in double precision, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take
    no part. Only vectors of equal length are compared. Rows with the query's id are its own, so no
    candidates; rows alike in id and vector count once, an id with several vectors has a list for each.
    With fewer candidates than ``k`` all are listed; a lone vector has no rows, nor has an empty table.
    Other columns are not read. ``confidence`` is the share of true neighbours that the stopping test
    keeps; ``dims`` must be even."""
    if dims % 2:
        raise ValueError("an even number of projected dimensions is needed")
    double = dict(vectors.dtypes)[vec_col] == "array<double>"
    kind, element = (np.float64, "double") if double else (np.float32, "float")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast(f"array<{element}>").alias("v")).where("i is not null")

    def packed(batches):
        for b in batches:
            for width, at, values in known_vectors(b.column(1)):
                live = values.any(axis=1)
                if width and live.any():
                    data = [same(x) for x in values[live].astype(kind) + kind(0)]  # -0 is 0
                    yield b.column(0).take(pa.array(at[live])), data

    def entries(batches):
        """Equal vectors of a task as one entry with its ``k`` + 1 least ids."""
        held: dict[bytes, list] = {}

        def out():
            size = 2000
            items = list(held.items())
            for lo in range(0, len(items), size):
                some = items[lo : lo + size]
                ids = [sorted(set(e[0]))[: k + 1] for _, e in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(v) for v, _ in some], pa.binary()), pa.array([v for v, _ in some], pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([e[1] for _, e in some], pa.bool_()), pa.array([e[2] for _, e in some], pa.int64())],
                    names=["key", "vec", "ids", "asked", "n"],
                )

        for ids, data in packed(batches):
            for i, v in zip(ids.to_pylist(), data, strict=True):
                e = held.setdefault(v, [[], False, 0])
                e[0].append(i)
                e[1] |= i % every == 0
                e[2] += 1
                if len(e[0]) > 8 * (k + 1):
                    e[0] = sorted(set(e[0]))[: k + 1]
            if len(held) > 200_000:
                yield from out()
                held.clear()
        yield from out()

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)  # a list of k + 1 for each task
    each = rows.mapInArrow(entries, ENTRY).groupBy("key").agg(F.first("vec").alias("vec"), least.alias("ids"), F.bool_or("asked").alias("asked"), F.sum("n").alias("n"))
    each = written(each, "entries")
    size = np.dtype(kind).itemsize
    widths = each.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"), F.bool_or("asked").alias("asked")).orderBy("bytes").collect()  # a row for each length
    lists = [_of_width(each.where(F.octet_length("vec") == r.bytes), r.n, r.bytes // size, kind, k, dims, confidence, seed, page) for r in widths if r.asked and r.rows > 1]

    def asks(batches):
        for ids, data in packed(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([xxhash.xxh3_128_digest(v) for v in data], pa.binary())], names=["query_id", "key"])

    asked = rows.where(F.col("i") % every == 0).mapInArrow(asks, "query_id long, key binary").distinct()
    if not lists:
        return asked.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    whole = lists[0]
    for t in lists[1:]:
        whole = whole.unionByName(t)
    whole = written(whole, "neighbours")
    dropped(each)
    hot = whole.where(F.col("n") >= max(2, sum(r.rows for r in widths) // HOT_SHARE)).drop("n")
    out = join_hot(asked, whole.drop("n"), "key", hot)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _of_width(each: DataFrame, count: int, width: int, kind: type, k: int, dims: int, confidence: float, seed: int, page: int) -> DataFrame:
    """(key, n, found) of the entries that are asked for: their ``k`` + 1 nearest (vec_id, score)."""
    spark, axes, quantile = each.sparkSession, directions(width, dims, seed), chi_square_quantile(confidence, dims)

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(float)

    def lengths(batches):
        top = max([float(np.linalg.norm(matrix(b.column(0)), axis=1).max()) for b in batches if b.num_rows], default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["top"])

    longest = each.select("vec").mapInArrow(lengths, "top double").agg(F.max("top")).first()[0]
    depth = max(0, min(math.ceil(math.log2(count / page)), int(math.log2(MOST_CELLS)), int(math.log2(FIT_ROWS / 32))))
    share = min(1.0, FIT_ROWS / count)

    def sample(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([same(projected(matrix(b.column(0)), axes, longest, False))], pa.binary())], names=["p"])

    some = each.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec") if depth else each.select("vec").limit(0)
    points = [np.frombuffer(r.p).reshape(-1, dims) for r in some.mapInArrow(sample, "p binary").collect()]  # ``dims`` numbers for each of about FIT_ROWS
    dim, at = planes(np.concatenate([*points, np.zeros((0, dims))]), depth)
    n_cells = 2**depth

    def cells(column, asked: bool) -> np.ndarray:
        return cells_of(projected(matrix(column), axes, longest, asked), dim, at)

    def tally(batches):
        own, asked = np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
        for b in batches:
            own += np.bincount(cells(b.column(0), False), minlength=n_cells)
            asked += np.bincount(cells(b.column(0).filter(b.column(1)), True), minlength=n_cells)
        yield pa.RecordBatch.from_arrays([pa.array(range(n_cells), pa.int64()), pa.array(own), pa.array(asked)], names=["cell", "n", "asked"])

    sizes = each.select("vec", "asked").mapInArrow(tally, "cell long, n long, asked long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect()  # a row for each of at most MOST_CELLS cells
    subs, blocks_in = np.ones(n_cells, np.int64), np.ones(n_cells, np.int64)
    for r in sizes:
        subs[r.cell], blocks_in[r.cell] = max(1, -(-r.n // page)), max(1, -(-r.asked // BLOCK))
    first_block = np.cumsum(blocks_in) - blocks_in

    def part(keys: list[bytes], of: np.ndarray) -> pa.Array:
        return pa.array(np.array([int.from_bytes(x[:7], "little") for x in keys], np.int64) % of)

    def deal(batches):
        for b in batches:
            cell = cells(b.column("vec"), False)
            yield pa.RecordBatch.from_arrays([pa.array(cell), part(b.column("key").to_pylist(), subs[cell]), b.column("vec"), b.column("ids")], names=["cell", "sub", "vec", "ids"])

    def build(key, table):
        x = matrix(table.column("vec"))
        p = projected(x, axes, longest, False)
        order, ends = bucket_order(p)
        ids = [np.array(i, np.int64) for i in table.column("ids").take(pa.array(order)).to_pylist()]
        p, begin = p[order], np.r_[0, ends[:-1]]
        lo, hi = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
        row = [key[0].as_py(), key[1].as_py(), same(x[order].astype(kind)), same(np.cumsum([len(i) for i in ids])), same(np.concatenate(ids)), same(ends), same(lo), same(hi)]
        return pa.table([pa.array([c]) for c in row], names=[c.split()[0] for c in PAGES.split(", ")])

    def ask(batches):
        for b in batches:
            home = cells(b.column("vec"), True)
            block = pa.array(first_block[home] + part(b.column("key").to_pylist(), blocks_in[home]).to_numpy())
            yield pa.RecordBatch.from_arrays([block, pa.array(home), b.column("key"), b.column("n"), b.column("vec")], names=["block", "home", "key", "n", "vec"])

    def gather(key, table):
        row = [key[0].as_py(), table.column("home")[0].as_py(), b"".join(table.column("key").to_pylist()), same(table.column("n").to_numpy().astype(np.int64)), b"".join(table.column("vec").to_pylist())]
        return pa.table([pa.array([c]) for c in row], names=[c.split()[0] for c in ASKED.split(", ")])

    pages = each.select("key", "vec", "ids").mapInArrow(deal, "cell long, sub long, vec binary, ids array<long>").groupBy("cell", "sub").applyInArrow(build, PAGES)
    pages = written(pages, "pages")
    blocks = each.where("asked").select("key", "n", "vec").mapInArrow(ask, "block long, home long, key binary, n long, vec binary").groupBy("block").applyInArrow(gather, ASKED)
    blocks = written(blocks, "blocks")
    want = k + 1  # a query may find its own row
    box_lo, box_hi = cell_boxes(dim, at, dims)

    def floors(n: int, q, score) -> np.ndarray:
        """The last of a query's best so far, where it has as many as it wants."""
        if q is None:
            return np.full(n, -np.inf)
        q, least = np.frombuffer(q, np.int64), np.full(n, np.inf)
        np.minimum.at(least, q, np.frombuffer(score))
        return np.where(np.bincount(q, minlength=n) == want, least, -np.inf)

    def go(batches, home_only: bool):
        """A row for each page that a block must look at: those of its own cell, or the others that a
        query's ball reaches."""
        for block, home, vecs, q, score in _rows(batches, ["block", "home", "vecs", "q", "score"]):
            x = np.frombuffer(vecs, kind).reshape(-1, width).astype(float)
            floor = floors(len(x), q, score)
            if home_only:
                to = [home]
            else:
                reach = quantile * np.maximum(2 * longest**2 - 2 * floor * longest / np.linalg.norm(x, axis=1), 0)
                near = (box_distances(projected(x, axes, longest, True), box_lo, box_hi) <= reach[:, None] * (1 + 1e-9)).any(axis=0)
                near[home] = False
                to = np.flatnonzero(near).tolist()
            pairs = [(c, s) for c in to for s in range(int(subs[c]))]
            for lo in range(0, len(pairs), 64):
                some = pairs[lo : lo + 64]
                m = len(some)
                columns = [[c for c, _ in some], [s for _, s in some], [block // TOGETHER] * m, [block] * m, [vecs] * m, [same(floor)] * m]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "sub", "together", "block", "vecs", "floor"])

    def look(table, held):
        if not table.num_rows or not held.num_rows:
            return _found([])
        at_page = Page(held.to_pylist()[0], kind, width, dims)
        out = []
        for r in table.select(["block", "vecs", "floor"]).to_pylist():
            x = np.frombuffer(r["vecs"], kind).reshape(-1, width).astype(float)
            got = best_of(*at_page.search(x, projected(x, axes, longest, True), np.frombuffer(r["floor"]), want + SPARE, longest, quantile), want)
            if len(got[0]):
                out.append((r["block"], *map(same, got)))
        return _found(out)

    def merge(batches):
        now, held = None, None
        for block, q, score, ids in _rows(batches, ["block", "q", "score", "id"]):
            got = (np.frombuffer(q, np.int64), np.frombuffer(score), np.frombuffer(ids, np.int64))
            if block != now and held is not None:
                yield from _found([(now, *map(same, held))]).to_batches()
            held = best_of(*got, want) if block != now else best_of(*(np.concatenate(x) for x in zip(held, got, strict=True)), want)
            now = block
        if held is not None:
            yield from _found([(now, *map(same, held))]).to_batches()

    def searched(state: DataFrame, home_only: bool) -> DataFrame:
        keys = ["cell", "sub", "together"]
        pairs = state.mapInArrow(lambda b: go(b, home_only), "cell long, sub long, together long, block long, vecs binary, floor binary")
        pairs = written(pairs, "visits")
        wanted = pairs.select("cell", "sub", F.col("together").alias("for_")).distinct()
        held = pages.join(wanted, ["cell", "sub"]).withColumnsRenamed({"cell": "at_cell", "sub": "at_sub"})
        out = pairs.groupBy(*keys).cogroup(held.groupBy("at_cell", "at_sub", "for_")).applyInArrow(look, FOUND)
        out = written(out, "looked")
        dropped(pairs)
        return out

    def merged(found: DataFrame) -> DataFrame:
        return found.repartition("block").sortWithinPartitions("block").mapInArrow(merge, FOUND)

    none = [F.lit(None).cast("binary").alias(c) for c in ("q", "score")]
    at_home = searched(blocks.select("block", "home", "vecs", *none), True)
    state = blocks.select("block", "home", "vecs").join(merged(at_home).select("block", "q", "score"), "block", "left")
    beyond = searched(state, False)

    def lists(batches):
        for keys, n, q, score, ids in _rows(batches, ["keys", "n", "q", "score", "id"]):
            q, score, ids = np.frombuffer(q, np.int64), np.frombuffer(score), np.frombuffer(ids, np.int64)
            cut = np.searchsorted(q, np.arange(len(keys) // 16 + 1)).tolist()
            found = [[{"vec_id": i, "score": s} for i, s in zip(ids[a:b].tolist(), score[a:b].tolist(), strict=True)] for a, b in zip(cut, cut[1:])]
            keys = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.frombuffer(n, np.int64)), pa.array(found, LIST)], names=["key", "n", "found"])

    last = merged(at_home.unionByName(beyond)).join(blocks.select("block", "keys", "n"), "block")
    out = written(last.mapInArrow(lists, "key binary, n long, found array<struct<vec_id:long,score:double>>"), "lists")
    dropped(pages, blocks, at_home, beyond)
    return out


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(c)[i].as_py() for c in names)


def op11_stable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
