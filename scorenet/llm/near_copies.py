"""Near copies by SimHash fingerprints in Gray order, every link decided by the exact Jaccard similarity.

A document's set of shingles gives its 64-bit fingerprint and a few keys, the least hashes among its
shingles. Two sets whose similarity reaches 4/5 share a key but for a chance of under one in a hundred,
and their fingerprints differ in more than ``MOST_BITS`` bits less often still. Documents with equal sets
are one node. The nodes that share a key form a block of the hierarchical Gray-order index, whose search
prunes groups of nodes by accumulated differences. Nodes with a candidate meet again with their whole
sets, a block a task or, where its sets are large, a pair of its parts; there candidates that links have
not joined yet are compared, and a forest of the links leaves the task, never their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorenet.llm.gray_index import GrayIndex, majority_bits
from scorenet.llm.text_units import give_back, join_hot, lower_words, nearly_among, rows_by_size
from scorenet.operators.components import connected_components
from scorenet.storage import dropped, written

#: The least similarity as a fraction.
OVER, UNDER = 4, 5
#: Differing bits of candidates. At 4/5 a fingerprint differs in 9.7 bits in the mean, deviation 2.9.
MOST_BITS = 20
#: Keys of a document among its rare shingles, and as many among frequent ones where these are so large
#: a part of its LOW least hashes.
KEYS, MANY_FREQUENT, LOW = 4, 0.35, 32
#: A shingle is frequent if it is among the LOW least of FREQUENT_FROM in SAMPLE_DOCS of all distinct sets,
#: of FREQUENT_FROM at least; every set is counted. So no more than LOW * SAMPLE_DOCS / FREQUENT_FROM are.
SAMPLE_DOCS, FREQUENT_FROM = 20_000, 3
#: Shingles of a task that compares sets, and of a block's part.
TASK_SHINGLES = 2_000_000
#: Hashes of a set that are compared between two looks at what the rest can still give.
STRETCH = 192
HOT_SHARE = 1000
#: Large blocks up to which their numbers of parts are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; fewer words than a shingle: the whole
    sequence is one. No words: none."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two ascending sets is at least OVER / UNDER, exactly. Stretches of hashes
    are compared from the least on; the sets are left as soon as all that remain could not be enough."""
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    need = -(-OVER * (len(a) + len(b)) // (OVER + UNDER))  # shared hashes from which they are alike
    both = at = 0
    for lo in range(0, len(a), STRETCH):
        if both + min(len(a) - lo, len(b) - at) < need:
            return False
        part = a[lo : lo + STRETCH]
        end = int(np.searchsorted(b, part[-1], "right"))
        both += len(np.intersect1d(part, b[at:end], assume_unique=True))
        at = end
    return both >= need


def keys_of(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Keys of a set of which ``h`` are the least hashes: the least of its rare shingles; of its frequent
    ones too where those are so many that differences elsewhere could leave the rare ones apart. ``often``
    is sorted."""
    if not len(often) or not len(h):
        return h[:KEYS]
    known = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
    rare = h[~known]
    if len(h) - len(rare) >= MANY_FREQUENT * len(h):
        return np.concatenate([rare[:KEYS], h[known][:KEYS]])
    return rare[:KEYS]


def frequent_shingles(nodes: DataFrame, count: int) -> np.ndarray:
    """Hashes that are among the least (``low``) of many of all ``count`` distinct sets, ascending. Keys come
    from the same lists, so no block of a rare key has more sets than that."""
    many = max(FREQUENT_FROM, math.ceil(FREQUENT_FROM * count / SAMPLE_DOCS))
    often = nodes.select(F.explode("low").alias("h")).groupBy("h").count().where(F.col("count") >= many)
    return np.sort(often.select("h").toArrow().column("h").to_numpy().view(np.uint64))  # at most LOW * SAMPLE_DOCS / FREQUENT_FROM rows


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in rows])].astype(np.int32)), flat)


def candidates(key: np.ndarray, n: np.ndarray, fp: np.ndarray):
    """Arrays (i, j) of rows that share a key, in nearly as many shingles, whose fingerprints are near."""
    index = GrayIndex(key, fp.view(np.uint64))
    for i, j in index.pairs(MOST_BITS):
        i, j = index.order[i], index.order[j]
        ok = UNDER * np.minimum(n[i], n[j]) >= OVER * np.maximum(n[i], n[j])
        if ok.any():
            yield i[ok], j[ok]


def least_shared(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the least that rows of keys ``a`` and ``b`` share, so that one block has the pair."""
    out = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        own = a[:, k]
        out &= ~((own < key) & (b == own[:, None]).any(1))
    return out


def near_copies(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) for every row with an id: the least id that links of alike documents reach.

    Links join documents whose sets of shingles, of whole texts, have a similarity of at least 4/5, by
    exact comparison. Null and empty texts are alike. Rows with a null id link with nothing. Repeated
    rows repeat; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def sketch(batches):
        for ids, rows in rows_by_size(batches, 500):
            nodes, sizes, fps, low = [], [], [], []
            for t in rows:
                h = shingle_hashes(t, shingle)
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                fps.append(majority_bits(h.view(np.uint8)))
                low.append(h[:LOW].view(np.int64))
            lists = _lists(low)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), lists], names=["doc_id", "node", "n", "fp", "low"])

    whole = written(texts.mapInArrow(sketch, "doc_id long, node long, n long, fp long, low array<long>"), "sketches")
    nodes = whole.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("low").alias("low"), F.count(F.lit(1)).alias("rows"))
    least = written(nodes, "least")
    frequent = spark.sparkContext.broadcast(frequent_shingles(least, least.count()))

    def keyed(batches):
        often = frequent.value
        for b in batches:
            low = b.column(5)
            flat, at = low.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(low.value_lengths().to_numpy())]
            keys = [keys_of(flat[i:j], often).view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _lists(keys)], names=["node", "id", "n", "fp", "rows", "keys"])

    nodes = least.select("node", "id", "n", "fp", "rows", "low").mapInArrow(keyed, "node long, id long, n long, fp long, rows long, keys array<long>")
    nodes = written(nodes, "nodes")
    dropped(least)

    def met(batches):
        def done(t):
            got = [t.column(c).to_numpy() for c in ("key", "n", "fp")]
            near = np.zeros(t.num_rows, bool)
            for i, j in candidates(*got):
                near[i] = near[j] = True
            return [b for b in t.filter(pa.array(near)).to_batches() if b.num_rows]

        held, n = [], 0
        for b in batches:  # sorted by key: a full batch is cut before its last key
            held.append(b)
            n += b.num_rows
            if n > 100_000:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from done(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    n -= cut
        if n:
            yield from done(pa.Table.from_batches(held))
        give_back()

    dealt = nodes.select(F.explode("keys").alias("key"), "node", "n", "fp")
    blocks = written(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(met, dealt.schema), "blocks")

    def full(batches):
        for _, rows in rows_by_size(batches, 500):
            held = [shingle_hashes(t, shingle) for t in rows]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in held], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.tobytes() for h in held], pa.binary())], names=["node", "hashes"])

    there = written(nodes.join(blocks.select("node").distinct(), "node", "left_semi").select("node", "keys", F.col("id").alias("doc_id")), "there")
    # Rows that share an id may differ in text: each gives a set, and the node tells which is meant.
    some = nearly_among(texts, there, "doc_id", there.count())  # others are not shuffled
    sets = some.join(there.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(full, "node long, hashes binary").dropDuplicates(["node"])
    sets = sets.join(there.select("node", "keys"), "node")
    sizes = written(blocks.groupBy("key").agg(F.sum("n").alias("shingles")), "sizes")
    every = sizes.agg(F.sum("shingles")).first()[0] or 0
    parts = sizes.where(F.col("shingles") > TASK_SHINGLES).select("key", F.ceil(F.col("shingles") / TASK_SHINGLES).cast("int").alias("parts"))
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    cut = blocks.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    # A part meets itself and every other part of its block, in the task of both.
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "own").alias("a"), F.greatest(x, "own").alias("b"))))
    cut = cut.withColumn("own", own).withColumn("to", to).select("key", "node", "n", "fp", "own", "to", "parts")
    tasks = max(1, -(-every // TASK_SHINGLES))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "to"))
    cut = cut.select("key", "node", "n", "fp", "own", F.xxhash64("key", "to").alias("tile"), (F.col("to.a") == F.col("to.b")).alias("alone"), task.alias("task"))
    written_sets = written(sets, "sets")
    joined = cut.join(written_sets, "node")

    def link(table: pa.Table) -> pa.Table:
        tile, n, fp, node, key = (table.column(c).to_numpy() for c in ("tile", "n", "fp", "node", "key"))
        own, alone = table.column("own").to_numpy(), table.column("alone").to_numpy(zero_copy_only=False)
        keys = np.zeros((len(node), 2 * KEYS), np.int64)
        lists = table.column("keys").to_pylist()
        for k, x in enumerate(lists):
            keys[k] = [*x, *[x[0]] * (2 * KEYS - len(x))]
        hashes = table.column("hashes").to_pylist()
        label = list(range(len(node)))

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        u, v = [], []
        for i, j in candidates(tile, n, fp):
            for lo in range(0, len(i), 20_000):
                a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
                mine = (alone[a] | (own[a] != own[b])) & least_shared(keys[a], keys[b], key[a])
                for x, y in zip(a[mine].tolist(), b[mine].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q and alike(np.frombuffer(hashes[x], np.uint64), np.frombuffer(hashes[y], np.uint64)):
                        label[max(p, q)] = min(p, q)
                        u.append(node[x])
                        v.append(node[y])
        give_back()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    found = written(joined.groupBy("task").applyInArrow(link, "u long, v long"), "links")
    dropped(blocks, there, sizes, written_sets)
    comps = connected_components(found).select(F.col("id").alias("node"), "comp")
    linked = written(nodes.join(comps, "node", "left").select("node", "id", "rows", F.coalesce("comp", "node").alias("comp")), "linked")
    dropped(nodes)
    # Only components of several nodes, each node a row, meet by component.
    least = linked.where("comp <> node").groupBy("comp").agg(F.min("id").alias("low"))
    least = least.join(linked.select(F.col("node").alias("comp"), "id"), "comp").select("comp", F.least("low", "id").alias("low"))
    sizes = linked.groupBy("comp").count().where(F.col("count") >= max(2, linked.count() // HOT_SHARE)).select("comp")
    owned = join_hot(linked, least, "comp", least.join(F.broadcast(sizes), "comp", "left_semi"), "left").select("node", "rows", F.coalesce("low", "id").alias("keep_id"))
    owned = written(owned, "owned")
    hot = owned.where(F.col("rows") >= max(2, whole.count() // HOT_SHARE)).drop("rows")
    return join_hot(whole.select("doc_id", "node"), owned.drop("rows"), "node", hot).select("doc_id", "keep_id")
