"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

All segmentations of a text into pieces form a lattice. No piece joins text over the start of a run of
spaces or over a line feed, so the lattice falls into units there. Forward filtering sums the weights
of all paths to each place of a unit once for all its occurrences; backward sampling then draws each
occurrence's pieces from its end. Draws come from a counter-based generator keyed by the row's key, the
unit's number in the text and the step, so they do not depend on partitions, batches or retries.

A piece's weight is a power of its rank in the vocabulary: the scores of a vocabulary made by merges are
just the ranks of the merges, no probabilities, while frequencies fall about as powers of ranks. Characters without a piece, and the mark
that stands for a space where it occurs in a text itself, become bytes, so decoding restores any text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.backoff import KeyTable, mixed
from scorenet.llm.text_units import file_bytes, give_back, rows_of

SPACE = 0x2581  # the mark for a space in pieces
OWN_MARK = 0x110000  # that mark in a text, which no piece has
UNIT = re.compile(r" *[^ \n]+|\n| +")
POWER = 1.0
BYTE_LOG = -12.0
CHUNK_CHARS = 4_000_000  # of texts whose distinct units are filtered together
_B = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary with byte fallback, as tables for lattices."""

    def __init__(self, model: bytes, power: float = POWER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                if chr(SPACE) in piece.lstrip(chr(SPACE)) or "\n" in piece:
                    raise ValueError("a piece reaches over the end of a unit")
                self.text.append(piece.replace(chr(SPACE), " ").encode())
                by_size.setdefault(len(piece), []).append((i, self.hash(piece)))
        self.longest = max(by_size)
        self.found = {n: KeyTable(np.array([h for _, h in x], np.uint64), np.array([i for i, _ in x])) for n, x in by_size.items()}
        self.log = -power * np.log(np.arange(sp.get_piece_size()) + 2.0)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + ord(c) + 1) & (2**64 - 1)
        return int(mixed(np.array([h], np.uint64))[0])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before every text is taken off."""
        t = self.text
        return b"".join([t[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


class Lattice:
    """Lattices of distinct units, filtered forward: for each place of each unit, its incoming pieces
    with cumulative probabilities."""

    def __init__(self, units: list[str], pieces: Pieces):
        text = "".join(units)
        ch = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(u) for u in units])
        first = np.r_[0, np.cumsum(size)[:-1]]
        ch[ch == SPACE] = OWN_MARK
        ch[ch == 32] = SPACE
        left = np.repeat(first + size, size) - np.arange(len(ch))  # characters to the end of the unit
        begin, end, ids, log = [], [], [], []
        h = np.zeros(len(ch), np.uint64)
        single = np.zeros(len(ch), bool)
        with np.errstate(over="ignore"):
            for n in range(1, pieces.longest + 1):
                at = np.flatnonzero(left >= n)
                if not len(at):
                    break
                h[at] = h[at] * _B + ch[at + n - 1] + np.uint64(1)
                if n not in pieces.found:
                    continue
                row = pieces.found[n].find(mixed(h[at]))
                at, got = at[row >= 0], pieces.found[n].values[row[row >= 0]]
                if n == 1:
                    single[at] = True
                begin.append(at)
                end.append(at + n)
                ids.append(got)
                log.append(pieces.log[got])
        bare = np.flatnonzero(~single)  # as bytes
        begin.append(bare)
        end.append(bare + 1)
        ids.append(-1 - bare)
        log.append(np.full(len(bare), BYTE_LOG))
        begin, end, ids, log = map(np.concatenate, (begin, end, ids, log))
        order = np.lexsort((begin, end))
        begin, end, ids, log = begin[order], end[order], ids[order], log[order]
        self.ch, self.first, self.size = ch, first, size
        # The place after character x of the text is node x + 1; a unit's start is known by its first.
        weight = np.zeros(len(ch) + 1)  # of the paths to a node from its unit's start, as a logarithm
        starts = np.zeros(len(ch) + 1, bool)
        starts[first] = True
        depth = end - np.repeat(first, size)[end - 1]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
        share = np.zeros(len(end))
        for a, b in zip(cuts, cuts[1:], strict=False):
            e = by_depth[a:b]  # edges that end at this depth, by end
            to = end[e]
            new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            w = log[e] + np.where(starts[begin[e]], 0.0, weight[begin[e]])
            top = np.maximum.reduceat(w, new)
            n = np.diff(np.r_[new, len(e)])
            x = np.exp(w - np.repeat(top, n))
            total = np.add.reduceat(x, new)
            # a unit's end may be the next one's start: nodes are read as starts by `starts` above
            weight[to[new]] = top + np.log(total)
            share[e] = x / np.repeat(total, n)
        self.begin, self.ids = begin, ids
        new = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
        n = np.diff(np.r_[new, len(end)])
        run = share.copy()  # summed up within each node, so that no draw depends on what else is there
        for k in range(1, int(n.max(initial=0))):
            more = new[n > k] + k
            run[more] += run[more - 1]
        upto = np.minimum(np.floor(run * 2.0**32), 2.0**32).astype(np.int64)
        if len(new):
            upto[np.r_[new[1:], len(end)] - 1] = 1 << 32
        self.sums = (end.astype(np.int64) << 32) + upto  # node, then cumulative probability: sorted over all

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges in text order, edges of each occurrence) for occurrences of units with their keys."""
        node = (self.first + self.size)[unit]
        start = self.first[unit]
        live = np.arange(len(unit))
        steps, k = [], 0
        count = np.zeros(len(unit), np.int64)
        with np.errstate(over="ignore"):
            while len(live):
                u = (mixed(key[live] + np.uint64(k) * _B) >> np.uint64(32)).astype(np.int64)
                edge = np.searchsorted(self.sums, (node[live].astype(np.int64) << 32) + u, side="right")
                steps.append((live, edge))
                node[live] = self.begin[edge]
                count[live] += 1
                live = live[node[live] > start[live]]
                k += 1
        last = np.cumsum(count)
        out = np.zeros(int(count.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            out[last[who] - 1 - k] = edge
        return out, count

    def expand(self, edges: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each edge): a byte edge stands for all bytes of its character."""
        ids = self.ids[edges]
        n = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, n
        code = self.ch[-1 - ids[bare]].astype(np.int64)
        code[code == OWN_MARK] = SPACE
        distinct, at = np.unique(code, return_inverse=True)
        bytes_of = [pieces.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in distinct]
        n[bare] = np.array([len(b) for b in bytes_of])[at]
        out = np.repeat(ids, n)
        to = np.cumsum(n) - n
        for k in range(4):
            more = np.flatnonzero(n[bare] > k)
            out[to[bare[more]] + k] = np.array([b[k] if len(b) > k else 0 for b in bytes_of])[at[more]]
        return out, n


def row_key(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"" if key is None else str(key).encode(), seed)


def sample_ids(texts: list[str | None], keys: list[object], pieces: Pieces, seed: int = 0) -> list[np.ndarray]:
    """Sampled ids of whole texts; null counts as empty, which has no ids."""
    number: dict[str, int] = {}
    unit, owner_n = [], []
    for t in texts:
        parts = UNIT.findall(" " + t) if t else []
        unit += [number.setdefault(p, len(number)) for p in parts]
        owner_n.append(len(parts))
    if not number:
        return [np.zeros(0, np.int64) for _ in texts]
    lattice = Lattice(list(number), pieces)
    owner_n = np.array(owner_n)
    with np.errstate(over="ignore"):
        inside = np.arange(len(unit)) - np.repeat(np.cumsum(owner_n) - owner_n, owner_n)
        key = mixed(np.repeat(np.array([row_key(k, seed) for k in keys], np.uint64), owner_n) + inside.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    edges, count = lattice.sample(np.array(unit), key)
    ids, n = lattice.expand(edges, pieces)
    per_unit = np.add.reduceat(n, np.cumsum(count) - count)
    ends = np.cumsum(per_unit)
    stops = np.r_[0, ends][np.cumsum(owner_n)]
    return np.split(ids, stops[:-1])


_held: dict[int, Pieces] = {}


def pieces_for(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(model)
    return _held[key]


def encode(docs: DataFrame, model: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row, sampled from its whole text.

    Rows with the same key and text get the same ids, wherever they stand; a null key counts as the
    empty string. Null and empty texts have no ids. An empty table gives an empty result; other columns
    are not read. A very long word is filtered place by place, in memory that grows with its length."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(batches):
        pieces = pieces_for(data.value)
        for ids, texts in rows_of(batches, 1 << 30):
            lo = 0
            while lo < len(texts):  # chunks of a bounded number of characters
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                got = sample_ids(texts[lo:hi], ids[lo:hi], pieces, seed)
                flat = np.concatenate(got).astype(np.int32)
                ends = np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])
                lo = hi
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text) of rows (doc_id, ids): the text restored from the ids; the
    checksum is of little-endian unsigned 32-bit integers. Null ids count as none."""
    data = encoded.sparkSession.sparkContext.broadcast(file_bytes(model))

    def run(batches):
        pieces = pieces_for(data.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [np.array(x or [], np.int64) if x is None else np.asarray(x.values.to_numpy() if hasattr(x, "values") and x.values is not None else [], np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()), pa.array([pieces.decode(r) for r in rows], pa.string())], names=["doc_id", "n_pieces", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text string")


def op6_piece_sampling(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Encodes every document and decodes the ids again: their number and checksum, and the SHA-256 of
    the text restored from them."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    return out.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
