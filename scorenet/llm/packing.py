"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document's full sequences are cut off first. What remains of each is dealt by a hash into packing
groups of bounded size. In a group, pieces go in descending length to the sequence with the lowest
estimated cost (linear plus quadratic attention cost) among those with enough capacity left; a piece
that fits nowhere is cut to fill the roomiest one. All sequences of a group but the last are full.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import encoder_for, file_bytes, rows_by_size

CAPACITY = 1024
GROUP_DOCS = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost(length: int) -> float:
    """Estimated cost of one piece: its tokens plus its attention, which grows with their square."""
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces of given lengths.

    As few sequences as can hold all tokens. Ties go to the earlier piece and the lower sequence."""
    total = sum(lengths)
    bins = -(-total // capacity)
    room = [[] for _ in range(capacity + 1)]  # by capacity left: a heap of (cost, sequence)
    room[capacity] = [(0.0, b) for b in range(bins)]
    best = np.full(capacity + 1, np.inf)
    best[capacity] = 0.0 if bins else np.inf
    out = []

    def put(piece: int, start: int, length: int, left: int) -> None:
        was, b = heapq.heappop(room[left])
        best[left] = room[left][0][0] if room[left] else np.inf
        out.append((piece, start, length, b, capacity - left))
        if left > length:
            heapq.heappush(room[left - length], (was + cost(length), b))
            best[left - length] = room[left - length][0][0]

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, length = 0, lengths[piece]
        while length:
            at = length + int(np.argmin(best[length:])) if length <= capacity else capacity
            if length > capacity or best[at] == np.inf:
                at = int(np.flatnonzero(best < np.inf)[-1])
                take = min(at, length)
            else:
                take = length
            put(piece, start, take, at)
            start, length = start + take, length - take
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and
    the ids themselves if ``with_ids``.

    Each whole text is encoded and ``end_id`` appended; null counts as empty and gives the end id
    alone. A sequence_id is the packing group and the sequence's number in it. Rows with equal id and
    text are separate documents, which go to groups by their place, but for the first of each chunk. An empty table gives an empty result; other columns
    are not read. Long documents send only lengths and checksums of their full sequences through the
    shuffle, and ids of the remainder."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(file_bytes(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-rows.count() // group_docs))
    tail, size = struct.pack("<I", end_id), 4 * capacity
    kinds = (("grp", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()))

    def encode(batches):
        to_ids = encoder_for(data.value).encode_all
        task = TaskContext.get().partitionId()
        for chunk, (ids, texts) in enumerate(rows_by_size(batches)):
            held, again = [], {}
            for i, got in zip(ids, to_ids(texts), strict=True):
                got += tail
                n, full = len(got) // 4, len(got) // size
                own = struct.pack("<qI", i or 0, zlib.crc32(got))
                again[own] = k = again.get(own, -1) + 1
                g = zlib.crc32(own + (struct.pack("<3I", task, chunk, k) if k else b"")) % groups
                for k in range(full):
                    part = got[k * size : (k + 1) * size]
                    held.append((g, i, k * capacity, capacity, zlib.crc32(part), n, part if with_ids else None))
                if n > full * capacity:
                    held.append((g, i, full * capacity, n - full * capacity, 0, n, got[full * size :]))
            cols = list(zip(*held, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])

    def place(key, table):
        rows = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending")]).to_pydict()
        whole = [i for i, n in enumerate(rows["length"]) if n == capacity]
        part = [i for i, n in enumerate(rows["length"]) if n < capacity]
        base = key[0].as_py() << 32
        out = []
        for p, start, length, b, offset in assign([rows["length"][i] for i in part], capacity):
            i = part[p]
            ids = rows["ids"][i][4 * start : 4 * (start + length)]
            out.append((rows["doc_id"][i], rows["start"][i] + start, length, zlib.crc32(ids), rows["doc_tokens"][i], base + b, offset, ids))
        first = base + 1 + max((x[5] - base for x in out), default=-1)
        out += [(rows["doc_id"][i], rows["start"][i], capacity, rows["crc"][i], rows["doc_tokens"][i], first + k, 0, rows["ids"][i]) for k, i in enumerate(whole)]
        cols = list(zip(*out, strict=True)) or [[]] * 8
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset") + (("ids",) if with_ids else ())
        return pa.table([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names, strict=False)], names=list(names))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    pieces = rows.mapInArrow(encode, "grp long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary")
    return pieces.groupBy("grp").applyInArrow(place, schema)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or _tokenizer(), 0)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stage is given."""
    return pack(docs, _tokenizer(), 0)
