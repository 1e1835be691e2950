"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Other white space than ASCII's, for which splitting at ASCII white space may not be exact.
ODD_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: What a text must not hold, nor begin or end with, to be cut at single spaces and line feeds alone.
PLAIN_NOT = ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r", "\x01", "\x02")
#: Marks of pieces that do not start with the white space before them.
MARKS = ("\x01", "\x02")
#: How a byte-level vocabulary spells a space and a line feed.
BYTE_SPACES = ("\u0120", "\u010a")
#: A piece of one id to part others by, and how many pieces the library gets as one text.
BAR, TOGETHER = "0", 100
#: Bits of a map of keys at most, 16 MB, and those of one of its pieces, which is one of Spark's bitmaps.
MAP_BITS, PIECE_BITS = 27, 15
SPACED_WORD = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; null counts as empty.

    ``bytes.lower`` and ``bytes.split`` touch ASCII alone, which is exactly that rule."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1, where composition changes nothing and each letter has its
    own lower case, so that a vocabulary which lower-cases gives both cases the same ids."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple[list, ...]]:
    """Columns as Python lists, ``most`` rows at a time, so that memory stays bounded."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            yield tuple(c.to_pylist() for c in part.columns)


def give_back() -> None:
    """Return unused memory to the system, as a worker process lives on after its task; glibc keeps
    what was freed unless told to trim."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_by_size(batches: Iterator[pa.RecordBatch], most: int = 1500, most_chars: int = 3_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at most ``most`` rows and, but for a single longer text, ``most_chars`` characters.
    After each, Arrow's unused memory goes back, as the worker process lives on."""
    pool = pa.default_memory_pool()
    for ids, texts in rows_of(batches, most):
        lo = size = 0
        for hi, t in enumerate(texts):
            if hi > lo and size + len(t or "") > most_chars:
                yield ids[lo:hi], texts[lo:hi]
                pool.release_unused()
                lo, size = hi, 0
            size += len(t or "")
        if texts:
            yield ids[lo:], texts[lo:]
            pool.release_unused()
    give_back()


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (unique by ``key``). ``hot``: the rows of ``right`` whose key has at
    least a fixed share of the rows of ``left``; their number is bounded by that share, so they are
    broadcast and a key that holds a third of all rows never meets in one task."""
    many = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.join(F.broadcast(hot.select(key)), key, "left_anti"), key, how)
    return left.join(many, key).unionByName(rest)


def nearly_among(rows: DataFrame, keys: DataFrame, key: str, count: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``rows`` whose key is one of ``keys``, of which there are ``count``, and few others; with
    "left_anti" the rest. Keys, integers, are told by one bit each of a bitmap of their hashes, which has
    16 bits a key but 2 ** MAP_BITS at most, whatever their number. An exact join of what it lets through may
    follow: it shuffles few of the rows that it drops."""
    bits = min(MAP_BITS, max(PIECE_BITS, (16 * count).bit_length()))
    at = F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    piece, place = F.shiftright(at, PIECE_BITS), at.bitwiseAND(F.lit((1 << PIECE_BITS) - 1).cast("long"))
    # A piece's keys meet before they become bits: a task would else hand on bits of all pieces.
    maps = keys.select(piece.alias("_piece"), place.alias("_place")).repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_place").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (piece == F.col("_piece")) & (F.getbit(byte, place.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1), how)


def file_bytes(path: str) -> bytes:
    """A tokenizer's file, read on the driver; it is sent to the executors as a broadcast value."""
    with open(path, "rb") as f:
        return f.read()


class MemoEncoder:
    """Exact token ids of whole texts by the tokenizers library, remembering words.

    The pre-tokenizers of the two public files never join text over the start of a white-space run,
    so a text is cut there, each distinct piece is encoded by the library once, and the ids are put
    together. A text with other than ASCII white space goes to the library whole. Strings of special
    tokens are ordinary text. ``most`` pieces, or ``most_bytes`` of them, bound what is remembered from
    call to call. Pieces are told apart and looked up as columns, so only new ones become objects."""

    def __init__(self, data: bytes, most: int = 700_000, most_bytes: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_buffer(data)
        self.tok.encode_special_tokens = True
        self.drops_space = (getattr(self.tok.model, "end_of_word_suffix", None) or "") == "</w>"
        self.lowers = self.drops_space and self._plain(["A\xc9\xde"]) == self._plain(["a\xe9\xfe"])
        self.as_is = self.tok
        if self.lowers:  # lower-case ASCII with single spaces is what the normalizer would make of it
            self.as_is = Tokenizer.from_buffer(data)
            self.as_is.encode_special_tokens = True
            self.as_is.normalizer = None
        #: Remembered pieces, and where each one's ids lie in ``ids``.
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.first = self.size = np.zeros(0, np.int64)
        self.most, self.most_bytes = most, most_bytes
        vocab = self.tok.get_vocab()
        self.starts, self.ends, self.bars = (np.zeros(max(vocab.values()) + 1, bool) for _ in range(3))
        if self.drops_space:
            self.ends[[n for t, n in vocab.items() if t.endswith("</w>")]] = True
            self.bars[self._plain([BAR])[0][0]] = True
        else:
            self.starts[[n for t, n in vocab.items() if t[0] in BYTE_SPACES]] = True

    def _plain(self, parts: list[str], tok: Tokenizer | None = None) -> list[list[int]]:
        return [e.ids for e in (tok or self.tok).encode_batch_fast(parts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self._plain(parts)]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. The library takes many pieces joined to one text, whose ids are told
        apart by ids that only the start of a piece has; where spaces leave no trace, by those that end
        a word of plain letters, or by a bar between pieces that have none. Marked pieces, and those
        that have the bar, go alone."""
        out, alone = [b""] * len(pieces), []
        at = range(len(pieces))
        if self.drops_space:
            letters = [p.isascii() and p.isalpha() for p in pieces]
            alone += [i for i in at if BAR in pieces[i]]
            plain = [p.isascii() and p == p.lower() for p in pieces]
            for tok, same in ((self.as_is, True), (self.tok, False)):
                alone += self._apart(pieces, [i for i in at if letters[i] and plain[i] is same], " ".join, self.ends, 1, out, tok)
                alone += self._apart(pieces, [i for i in at if not letters[i] and plain[i] is same and BAR not in pieces[i]], f" {BAR} ".join, self.bars, 0, out, tok)
        else:
            alone += [i for i in at if pieces[i][:1] in MARKS]
            left = set(alone)
            alone += self._apart(pieces, [i for i in at if i not in left], lambda x: (" " + " ".join(x)).replace(" \n", "\n"), self.starts, -1, out, self.tok)
        for i, x in zip(alone, self._ids([self._text(pieces[i]) for i in alone]), strict=True):
            out[i] = x
        return out

    def _apart(self, pieces: list[str], at: list[int], join: Callable, sign: np.ndarray, kind: int, out: list[bytes], tok: Tokenizer) -> list[int]:
        """Puts the ids of ``pieces[i]`` for i in ``at`` to ``out``, from texts of joined pieces. ``sign``
        marks ids that start (kind -1), end (1) or part (0) pieces. Returns those i whose text has not
        just as many signs as that takes."""
        runs = [at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)]
        missed: list[int] = []
        for run, ids in zip(runs, self._plain([join([pieces[i] for i in run]) for run in runs], tok), strict=True):
            data = array("I", ids).tobytes()
            cut = 4 * np.flatnonzero(sign[np.frombuffer(data, np.uint32)])
            if len(cut) != len(run) - (kind == 0):
                missed += run
                continue
            if kind < 0:
                begin, end = cut.tolist(), [*cut[1:].tolist(), len(data)]
            else:
                after = (cut + 4).tolist()
                begin, end = [0, *(after[:-1] if kind else after)], after if kind else [*cut.tolist(), len(data)]
            for i, a, b in zip(run, begin, end, strict=True):
                out[i] = data[a:b]
        return missed

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, list[int]]:
        """(pieces, pieces of each text, texts in their order). Where single spaces and line feeds stand
        between words alone, a piece leaves its space out, and the first piece, which has none, has a
        mark; all other texts are cut by pattern, and their pieces have another mark."""
        at = range(len(texts))
        if self.drops_space:
            cut = pc.ascii_split_whitespace(pa.array([(t.lower() if self.lowers and is_latin(t) else t).strip() for t in texts], pa.string()))
            counts = np.diff(cut.offsets.to_numpy())
            counts[[i for i, t in enumerate(texts) if not t.strip()]] = 0
            return cut.flatten().filter(pc.not_equal(cut.flatten(), "")), counts, list(at)
        plain = [t != "" and t[0] not in " \n" and t[-1] not in " \n" and not any(x in t for x in PLAIN_NOT) for t in texts]
        even, odd = [i for i in at if plain[i]], [i for i in at if not plain[i]]
        cut = pc.split_pattern(pa.array(["\x01" + texts[i].replace("\n", " \n") for i in even], pa.string()), " ")
        other = [["\x02" + p for p in SPACED_WORD.findall(texts[i])] for i in odd]
        pieces = pa.concat_arrays([cut.flatten(), pa.array([p for x in other for p in x], pa.string())])
        return pieces, np.r_[np.diff(cut.offsets.to_numpy()), np.array([len(x) for x in other], np.int32)], even + odd

    def _text(self, piece: str) -> str:
        if self.drops_space or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] in MARKS else " " + piece

    def _learn(self, words: pa.Array) -> None:
        got = self._piece_ids(words.to_pylist())
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        self.first = np.r_[self.first, len(self.ids) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(got), np.uint32)]

    def _keep(self, most: int) -> None:
        """Forget all but the first pieces, and of those any of more than 64 bytes."""
        short = np.flatnonzero(pc.binary_length(self.words).to_numpy()[:most] <= 64)
        n = self.size[short]
        where = np.repeat(self.first[short] - np.cumsum(n) + n, n)
        self.ids = self.ids[where + np.arange(len(where))]
        self.words, self.size, self.first = self.words.take(pa.array(short)), n, np.cumsum(n) - n

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty. Equal texts
        of a call are encoded once."""
        distinct = list(dict.fromkeys(texts))
        if len(distinct) < len(texts):
            got = dict(zip(distinct, self.encode_all(distinct), strict=True))
            return [got[t] for t in texts]
        out = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and ODD_SPACE.search(t)]
        for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = x
        left = set(whole)
        rest = [i for i, t in enumerate(texts) if t and i not in left]
        if not rest:
            return out
        if len(self.words) > self.most or self.words.nbytes > self.most_bytes:
            self._keep(min(self.most, len(self.words)) // 2)  # frequent pieces are among those that came first
        pieces, counts, order = self._pieces([texts[i] for i in rest])
        coded = pieces.dictionary_encode()
        row = pc.index_in(coded.dictionary, value_set=self.words)
        new = np.flatnonzero(row.is_null().to_numpy(zero_copy_only=False))
        row = row.fill_null(0).to_numpy().astype(np.int64)
        row[new] = len(self.words) + np.arange(len(new))
        self._learn(coded.dictionary.take(pa.array(new)))
        at = row[coded.indices.to_numpy()]
        n, first = self.size[at], self.first[at]
        ends = np.cumsum(n)
        where = np.repeat(first - ends + n, n)
        where += np.arange(len(where))
        ids = self.ids[where].tobytes()
        stops = (4 * np.r_[0, ends][np.cumsum(counts)]).tolist()
        for i, a, b in zip(order, [0, *stops], stops, strict=False):
            out[rest[i]] = ids[a:b]
        return out


_encoders: dict[int, MemoEncoder] = {}


def encoder_for(data: bytes) -> MemoEncoder:
    """One encoder for each file and worker process; it lives on from task to task."""
    key = hash(data)
    if key not in _encoders:
        forget_encoders()
        _encoders[key] = MemoEncoder(data)
    return _encoders[key]


def forget_encoders() -> None:
    """Give an encoder's memory back in a worker process that goes on to another operator."""
    _encoders.clear()
    give_back()
