"""SimHash near-dedup with a hierarchical index in Gray order.

Distinct fingerprints are dealt by blocks of their bits (two fingerprints that differ in few bits
agree, or nearly agree, on one block). In each task the fingerprints of a block value are sorted by
their rank in the Gray code. Runs of neighbours become nodes that hold the bit pattern all of them
share; nodes are grouped again up to one root for each block value. A search walks down from the
root, adds up the differences with each node's newly shared bits and prunes the node, with all below
it, once they exceed the limit. Links found become a forest in the task; classes come from connected
components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.gray_index import GrayIndex, majority_bits
from scorenet.llm.near_copies import near_copies
from scorenet.llm.text_units import give_back, join_hot, lower_words, nearly_among, rows_by_size
from scorenet.operators.components import connected_components, merge_labels
from scorenet.storage import dropped, written

HOT_SHARE = 1000


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """64 bits as a signed integer; bit set if it is set in over half the hashes of the shingles,
    repeats included. Fewer words than a shingle: the whole sequence is one. No words: zero."""
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = b"".join([xxhash.xxh64_digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))])
    return majority_bits(np.frombuffer(hashes, np.uint8))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row, from its whole text; null counts as empty."""

    def run(batches):
        for ids, texts in rows_by_size(batches):
            fps = [fingerprint(lower_words(t), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: np.ndarray, blocks: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) so that any two fingerprints with at most ``most`` differing bits share a key.

    One of the blocks differs in at most r = most // blocks bits. Then both blocks lie within
    (r + 1) // 2 bits of a word between them, so each row gets the words around its block."""
    reach = (most // blocks + 1) // 2
    rows, keys = [], []
    at = np.arange(len(fp))
    for b, (shift, width) in enumerate(block_bounds(blocks)):
        part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        for r in range(reach + 1):
            for flip in combinations(range(width), r):
                rows.append(at)
                keys.append((part ^ np.uint64(sum(1 << x for x in flip))) | np.uint64(b << 58) if width < 58 else part)
    return np.concatenate(rows), np.concatenate(keys)


def near_links(reps: DataFrame, most: int, blocks: int, heavy: int = 20_000, levels: int = 3) -> DataFrame:
    """Edges (u, v) between ids of ``reps`` (id long, fp long, distinct fp) that join just the ids
    that chains of fingerprints at most ``most`` bits apart join.

    Keys with more than ``heavy`` rows are dealt anew by blocks of the other bits, so that no task
    gets an unbounded group unless its fingerprints are alike in every block."""

    def key(batches):
        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            row, k = block_keys(fp, blocks, most)
            ids = b.column(0).to_numpy()
            for i in range(0, len(row), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000].view(np.int64)), pa.array(ids[row[i : i + 200_000]]), pa.array(fp[row[i : i + 200_000]].view(np.int64))], names=["key", "id", "fp"])

    keyed = reps.where("id is not null").select("id", "fp").mapInArrow(key, "key long, id long, fp long")
    keyed = written(keyed, "keyed")
    parts = most + 1
    for level in range(levels):
        many = keyed.groupBy("key").count().where(F.col("count") > heavy).select("key")
        many = written(many, "heavy")
        if many.isEmpty():
            dropped(many)
            break
        # The whole difference is at most `most` bits, so one of most + 1 cuts of all bits agrees.
        cuts = block_bounds(parts + level)
        deal = F.explode(F.array(*[F.xxhash64("key", F.lit(level), F.lit(s), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))) for s, w in cuts]))
        cold = keyed.join(many, "key", "left_anti")
        hot = keyed.join(many, "key", "left_semi").select(deal.alias("key"), "id", "fp")
        counts = hot.groupBy("key").count()
        if counts.where(F.col("count") > heavy).limit(1).count() and level == levels - 1:
            break
        before, keyed = keyed, written(cold.unionByName(hot), "keyed")
        dropped(before, many)

    def link(batches):
        def ends(keys, ids, fps):
            _, at, size = np.unique(keys, return_inverse=True, return_counts=True)
            many = size[at] > 1
            keys, ids, fps = keys[many], ids[many], fps[many].view(np.uint64)
            label = np.arange(len(ids))
            if len(ids):
                index = GrayIndex(keys, fps)
                ids = ids[index.order]
                for i, j in index.pairs(most):
                    merge_labels(label, i, j)
            other = label != np.arange(len(ids))
            u, v = ids[other], ids[label[other]]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, n = [], 0
        for b in batches:  # sorted by key: a full batch is cut before its last key
            held.append(b)
            n += b.num_rows
            if n > 100_000:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield ends(keys[:cut], t.column("id").to_numpy()[:cut], t.column("fp").to_numpy()[:cut])
                    held = t.slice(cut).to_batches()
                    n -= cut
        if held:
            t = pa.Table.from_batches(held)
            yield ends(*(t.column(c).to_numpy() for c in ("key", "id", "fp")))
        give_back()

    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link, "u long, v long"), "links")
    dropped(keyed)
    return found


def simhash_classes(docs: DataFrame, shingle: int = 3, most: int = 2, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; component_id is the least id
    reachable by links of at most ``most`` differing bits.

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are
    one class before anything is compared, so a group of copies of any size costs one fingerprint.
    Rows with a null id get their class's component_id but never lend it theirs; it is null if the
    class has no other id. Repeated rows come back as often as they were given; an empty table gives
    an empty result; other columns are not read."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    edges = near_links(reps, most, blocks or most + 1)
    comps = connected_components(edges).withColumnRenamed("comp", "_comp")
    known = reps.join(comps, "id", "left").select("fp", F.coalesce("_comp", "id").alias("component_id"), "n")
    known = written(known, "members")
    dropped(edges, reps)
    hot = known.where(F.col("n") >= max(2, fps.count() // HOT_SHARE)).drop("n")
    out = join_hot(fps, known.drop("n"), "fp", hot)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, most=2)


#: Of the pipeline's stage: words of a shingle.
STAGE_SHINGLE = 5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id, with all its columns.

    Groups are those that links join; the index finds candidates, and an exact similarity of 4/5 or more
    of their sets of five-word shingles makes them links. A document can lie in a group by a chain.
    Rows with a null id stay; rows that share an id stay if one of them does. Only texts of rows that may go
    are shuffled, to meet the ids that do."""
    kept = near_copies(docs, STAGE_SHINGLE).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("keep_id")).alias("stays"))
    gone = written(kept.where("not stays").select("doc_id"), "gone")
    count = gone.count()
    unsure = nearly_among(docs, gone, "doc_id", count).join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    return nearly_among(docs, gone, "doc_id", count, "left_anti").unionByName(unsure)
