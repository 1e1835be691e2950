"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout: data frames, an index frame, and a skippable frame with the seek table of the public
zstd seekable format (compressed size, decompressed size and a checksum for each frame). The index
frame holds, for each document, its id, its number of tokens and its frame, so that a reader
decompresses only the frames of the documents asked for, and checks each by its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import encoder_for, file_bytes, rows_by_size, rows_of
from scorenet.storage import fresh_path

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_TOKENS = 65_536


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents one after another; ``close`` adds index and seek table. A frame ends with the
    document that fills it, so a document lies in one frame, a very long one in its own."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.sink, self.most = sink, frame_tokens * 4
        self.pack = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def _frame(self, data: bytes) -> None:
        out = self.pack.compress(data)
        self.sink.write(out)
        self.entries.append((len(out), len(data), _checksum(data)))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.most:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.entries)))
        self.held.append(ids)
        self.size += len(ids)

    def close(self) -> None:
        self._flush()
        self._frame(b"".join(struct.pack("<q?qq", *d) for d in self.docs))
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to a file of ``FrameWriter``."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable token file")
        source.seek(end - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.unpack = zstandard.ZstdDecompressor()
        index = self.frame(n - 1)
        self.docs = [(None if null else i, tokens, f) for i, null, tokens, f in struct.iter_unpack("<q?qq", index)]

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        data = self.unpack.decompress(self.source.read(int(self.sizes[k])), max_output_size=int(self.raw[k]))
        if len(data) != self.raw[k] or _checksum(data) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; only the frames of ``wanted`` are decompressed."""
        pick = None if wanted is None else set(wanted)
        now, data, at = -1, b"", 0
        for doc_id, tokens, f in self.docs:
            if f != now:
                now, data, at = f, b"", 0
            if pick is None or doc_id in pick:
                data = data or self.frame(f)
                yield doc_id, data[at : at + 4 * tokens]
            at += 4 * tokens


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Encode every whole text, append ``end_id`` and write the files below ``uri`` in ascending order
    of id. Returns the manifest: (file, tokens) in that order, one entry for each partition.

    Null text counts as empty and gives the end id alone; a null id comes first; rows with the same id
    stand together, ordered by a hash of their text; repeated rows are all written. An empty table
    writes files without documents. Each attempt of a task writes a file of its own and renames it
    when complete, so lost executors and retried tasks leave whole files only."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(file_bytes(tokenizer))
    fs, root = _place(uri)
    fs.create_dir(root, recursive=True)
    tail = struct.pack("<I", end_id)

    def write(batches):
        task = TaskContext.get()
        fs, root = _place(uri)
        encode = encoder_for(data.value).encode_all
        name = f"{task.partitionId():06d}.tokens"
        part = f"{root}/.{name}.{task.taskAttemptId()}"
        tokens = 0
        with fs.open_output_stream(part) as sink:
            out = FrameWriter(sink)
            for ids, texts in rows_by_size(batches):
                for i, got in zip(ids, encode(texts), strict=True):
                    got += tail
                    tokens += len(got) // 4
                    out.add(i, got)
            out.close()
        fs.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "tokens": pa.array([tokens], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    done = ranged.mapInArrow(write, "part int, name string, tokens long").collect()  # one row for each file
    return [(f"{uri}/{r.name}", r.tokens) for r in sorted(done)]


def read_tokens(spark: SparkSession, manifest: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all
    documents before it."""
    starts = np.concatenate([[0], np.cumsum([n for _, n in manifest])]).tolist() if manifest else []

    def read(batches):
        for files, firsts in rows_of(batches):
            for uri, at in zip(files, firsts, strict=True):
                fs, path = _place(uri)
                with fs.open_input_file(path) as source:
                    held, size = [], 0
                    for doc_id, ids in FrameReader(source).read():
                        held.append((doc_id, at, len(ids) // 4, ids))
                        at += len(ids) // 4
                        size += len(ids)
                        if size > 4_000_000:
                            yield batch(held)
                            held, size = [], 0
                    yield batch(held)

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame([(f, s) for (f, _), s in zip(manifest, starts, strict=False)], "file string, first long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_frames(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "tokens"), tokenizer, 1)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
