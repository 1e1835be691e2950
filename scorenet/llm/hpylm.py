"""Language-model scoring by a hierarchical Pitman-Yor model of words.

A restaurant stands for the word before a token; the parent of all these is the restaurant of all words.
A restaurant's tables are its parent's customers. Tables of contexts are sampled by Gibbs steps twice: first
under the word shares of their shard, which gives the top restaurant its customers, then under the top as
it then stands; predictive probabilities are averaged over the samples of the second run. The top is not
sampled: it has one table for each known word, and what it keeps for new tables is the probability of the
unknown word, one event. Discounts come from numbers of pairs with one and two customers, the strength is
one for all restaurants.

Tokens are dealt by the word before them to shards, so that each shard holds whole context restaurants.
The number of shards and each one's seed follow from the data alone, so scores do not depend on how rows
lie in partitions. Tokens and their words travel as packed columns, a block for each shard. Shards send
what they have of each word to shards of words, which answer with sums over all; nothing of the vocabulary
goes to the driver. A word before more than ``UNIT`` tokens has several restaurants, one for each group of
words before it, each with about that many customers; scores of its tokens differ from those under a single
restaurant.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.backoff import mixed
from scorenet.llm.seating import Seating, discount_of
from scorenet.llm.text_units import give_back
from scorenet.storage import collect_shuffles, dropped, written

END, START = np.uint64(xxhash.xxh64_intdigest(b"")), np.uint64(1)  # no word is empty
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
FOLDS, HELD_OUT = 5, 1
#: Tokens that a task packs at once, of a shard, and before which one word stands as one restaurant.
CHUNK_TOKENS, SHARD_TOKENS, UNIT = 2_000_000, 1_500_000, 1_000_000
#: Most words with several restaurants: UNIT grows with the tokens so that no more can reach it.
MOST_SPLIT = 1_000_000

BLOCK = "shard long, chunk long, words binary, word binary, contexts binary, runs binary, doc binary, held binary, ids array<long>"


def fold_of(doc_id: object) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def chunks_of(batches, most: int = CHUNK_TOKENS):
    """(ids, hashes of distinct words, code of each token, tokens of each text) of some texts at a time;
    each text ends with the token END, whose code is the last but one; the last code is START."""
    ids, words, counts, n = [], [], [], 0

    def out():
        flat = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        got = flat.dictionary.to_pylist()
        hashes = np.r_[np.fromiter(map(xxhash.xxh64_intdigest, got), np.uint64, len(got)), END, START]
        size = np.concatenate(counts)
        codes = np.full(int(size.sum() + len(size)), len(got), np.int32)
        last = np.cumsum(size + 1) - 1
        inside = np.ones(len(codes), bool)
        inside[last] = False
        codes[inside] = flat.indices.to_numpy()
        return ids, hashes, codes, size + 1

    for b in batches:
        lo = 0
        while lo < b.num_rows:
            rows = min(500, b.num_rows - lo)
            text = pc.ascii_trim_whitespace(pc.ascii_lower(b.column(1).slice(lo, rows).fill_null("")))
            cut = pc.ascii_split_whitespace(text)
            size = np.diff(cut.offsets.to_numpy()).astype(np.int64)
            size[pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)] = 0
            flat = cut.flatten()
            ids += b.column(0).slice(lo, rows).to_pylist()
            words.append(flat.filter(pc.not_equal(flat, "")))
            counts.append(size)
            n += int(size.sum()) + rows
            lo += rows
            if n >= most:
                yield out()
                ids, words, counts, n = [], [], [], 0
    if ids:
        yield out()
    give_back()


def words_before(docs: DataFrame) -> DataFrame:
    """(key, n): how often each word stands in docs (id, text), by its hash."""

    def run(batches):
        for _, hashes, codes, _ in chunks_of(batches):
            n = np.bincount(codes, minlength=len(hashes))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:-1].view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, none negative, in as few bytes as the greatest takes, byte planes apart, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1)


def blocks(docs: DataFrame, shards: int, split: tuple[np.ndarray, np.ndarray], whole: bool) -> DataFrame:
    """The tokens of docs (id, text) as blocks, one for each shard and chunk: the contexts (hashes) and
    how many entries each has, then for each entry the word by a dictionary of hashes. ``whole``: an entry
    is a token, with its document's place in the chunk, and one block of a chunk has the ids. Else it is
    a pair of context and word, and ``doc`` is how many of its tokens are in training documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(split)

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        hot, groups = shipped.value
        for at, (ids, hashes, w, size) in enumerate(chunks_of(batches)):
            chunk = task + at
            first = np.cumsum(size) - size
            held = np.array([fold_of(i) == HELD_OUT for i in ids])
            n_words = len(hashes)
            v = np.r_[np.int32(0), w[:-1]]
            v[first] = n_words - 1
            with np.errstate(over="ignore"):
                own = mixed(hashes)
                context, cell = hashes, v.astype(np.int64)
                if len(hot):  # words with several restaurants: cells of their own
                    place = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                    parts = np.where(hot[place] == hashes, groups[place], 1)
                    many = np.flatnonzero(parts[v] > 1)
                    u = np.r_[np.int32(0), v[:-1]]
                    u[first] = n_words - 1
                    part = own[u[many]] % parts[v[many]].astype(np.uint64)
                    each, back = np.unique((v[many].astype(np.uint64) << np.uint64(32)) | part, return_inverse=True)
                    context = np.r_[hashes, mixed(hashes[(each >> np.uint64(32)).astype(np.int64)] + (each & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))]
                    cell[many] = n_words + back
                shard = (mixed(context) % np.uint64(shards)).astype(np.int64)[cell]
                start = cell == n_words - 1  # no context: anywhere, by the word itself
                shard[start] = (own[w[start]] % np.uint64(shards)).astype(np.int64)
            key = shard * len(context) + cell
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
            if whole:
                order = np.argsort(key, kind="stable")
                extra = doc[order]
            else:
                key = key * n_words + w
                order = np.argsort(key)
                one = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                extra = np.add.reduceat((~held)[doc[order]].astype(np.int64), one)
                order = order[one]
            shard, cell, w = shard[order], cell[order], w[order]
            bits = np.packbits(held).tobytes() if whole else None
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            code, rows = np.zeros(n_words, np.int64), []
            tells = int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(len(cuts))) if whole else -1
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(shard)], strict=True)):
                if b - a > n_words // 8:
                    code[:] = 0
                    code[w[a:b]] = 1
                    used = np.flatnonzero(code)
                else:
                    used = np.unique(w[a:b])
                code[used] = np.arange(len(used))
                runs = np.flatnonzero(np.r_[True, cell[a + 1 : b] != cell[a : b - 1]])
                rows.append((
                    int(shard[a]), chunk, hashes[used].tobytes(), _pack(code[w[a:b]]), context[cell[a:b][runs]].tobytes(),
                    _pack(np.diff(np.r_[runs, b - a])), _pack(extra[a:b]), bits, ids if k == tells else None,
                ))
                if len(rows) == 32 or b == len(shard):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
                    rows = []

    return docs.mapInArrow(run, BLOCK)


NAMES = [x.split()[0] for x in BLOCK.split(", ")]
TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]


class Shard:
    """The tokens of a shard by distinct pair of context and word. Pairs, contexts and words are in the
    order of hashes, whatever the order of the blocks."""

    def __init__(self, table: pa.Table, whole: bool):
        ws, cs, extra, docs, self.chunks = [], [], [], [], []
        base = 0
        for r in table.select(["chunk", "words", "word", "contexts", "runs", "doc", "held"]).to_pylist():
            words, runs, doc = np.frombuffer(r["words"], np.uint64), _unpack(r["runs"]), _unpack(r["doc"])
            ws.append(words[_unpack(r["word"])])
            cs.append(np.repeat(np.frombuffer(r["contexts"], np.uint64), runs))
            if whole:
                extra.append(np.unpackbits(np.frombuffer(r["held"], np.uint8))[doc] == 0)
                docs.append(doc.astype(np.int32) + base)
                most = int(doc.max()) + 1
                self.chunks.append((r["chunk"], base, base + most))
                base += most
            else:
                extra.append(doc)
        w, c, extra = np.concatenate(ws), np.concatenate(cs), np.concatenate(extra)
        self.doc = np.concatenate(docs) if whole else None
        del ws, cs, docs
        with np.errstate(over="ignore"):
            key = mixed(c * np.uint64(5) + mixed(w))
        _, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        del key
        self.count = np.bincount(self.pair, extra, len(first)).astype(np.int64)
        c, w = c[first], w[first]
        self.context = np.unique(c, return_inverse=True)[1]
        self.start = c == START
        self.words, self.word = np.unique(w, return_inverse=True)

    def seats(self, discount: float, seed: list[int]) -> Seating:
        return Seating(self.context, self.count, int(self.context.max()) + 1, discount, STRENGTH, np.random.default_rng(seed))

    def step(self, seats: Seating, top: np.ndarray) -> np.ndarray:
        """A Gibbs step; the probability of each pair's word. ``top``: that in the top restaurant."""
        seats.sweep(top)
        own, weight = seats.parts()
        return np.where(self.start, top, own + weight[self.context] * top)

    def top_customers(self, seats: Seating) -> np.ndarray:
        """Of each word; where there is no word before, tokens are the top's customers."""
        return np.bincount(self.word, np.where(self.start, self.count, seats.tables), len(self.words)).astype(np.int64)


def asked(tokens: DataFrame, word_bits: int, seed: int) -> DataFrame:
    """What each shard has of each word, by shards of words (the first bits of the hash): tokens and
    customers for the top restaurant, from a first seating. (by, shard, words, customers, tokens, and
    numbers of pairs with one and two customers)."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        s = Shard(table, False)
        c = np.bincount(s.word, s.count, len(s.words))
        top = (c + 0.5)[s.word] / (c.sum() + 0.5 * (len(c) + 1))  # the shard's tokens stand for all
        k = s.count[~s.start]
        once, twice = int((k == 1).sum()), int((k == 2).sum())
        seats = s.seats(discount_of(once, twice), [seed, number])
        for _ in range(BURN_IN):
            s.step(seats, top)
        customers = s.top_customers(seats)
        by = (s.words >> np.uint64(64 - word_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            rows.append((int(by[a]), number, s.words[a:b].tobytes(), _pack(customers[a:b]), _pack(c[a:b]), 0, 0))
        rows[0] = (*rows[0][:5], once, twice)
        give_back()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.int64()] * 2, strict=True)], names=["by", "shard", "words", "customers", "tokens", "once", "twice"])

    return tokens.groupBy("shard").applyInArrow(run, "by long, shard long, words binary, customers binary, tokens binary, once long, twice long")


def answers(asks: DataFrame) -> DataFrame:
    """For each row of ``asks`` the sums over all shards, in the order of its words; and of each shard of
    words, in one row, its known words, tokens, customers, and words with one and two customers."""

    def run(table: pa.Table) -> pa.Table:
        got = table.select(["by", "shard", "words", "customers", "tokens"]).to_pylist()
        words, back = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in got]), return_inverse=True)
        total = [np.bincount(back, np.concatenate([_unpack(r[c]) for r in got]), len(words)).astype(np.int64) for c in ("customers", "tokens")]
        rows, at = [], 0
        for r in got:
            n = len(r["words"]) // 8
            mine = back[at : at + n]
            rows.append((r["shard"], r["by"], _pack(total[0][mine]), _pack(total[1][mine]), 0, 0, 0, 0, 0))
            at += n
        k = total[0]
        rows[0] = (*rows[0][:4], *(int(x) for x in ((k > 0).sum(), total[1].sum(), k.sum(), (k == 1).sum(), (k == 2).sum())))
        give_back()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 5, strict=True)], names=["for_shard", "by", "customers", "tokens", "known", "n", "seated", "once", "twice"])

    return asks.select("by", "shard", "words", "customers", "tokens").groupBy("by").applyInArrow(run, "for_shard long, by long, customers binary, tokens binary, known long, n long, seated long, once long, twice long")


PARTS = "chunk long, doc binary, n binary, known binary, base binary, lp binary, held binary, ids array<long>"


def scored_blocks(tokens: DataFrame, told: DataFrame, discounts: tuple[float, float], n: int, v: int, seated: int, seed: int) -> DataFrame:
    """Sums for each document of a chunk over the tokens of a shard."""

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        s = Shard(table, True)
        got = sorted(answer.select(["by", "customers", "tokens"]).to_pylist(), key=lambda r: r["by"])
        customers, c = (np.concatenate([_unpack(r[k]) for r in got]).astype(np.int64) for k in ("customers", "tokens"))
        if len(c) != len(s.words):
            raise RuntimeError(f"shard {number} has {len(s.words)} words, answers have {len(c)}")
        top = np.where(customers > 0, customers - discounts[1], STRENGTH + discounts[1] * v) / (STRENGTH + seated)
        top = top[s.word]
        seats = s.seats(discounts[0], [seed, 1, number])
        p = np.zeros(len(s.count))
        for k in range(BURN_IN + SAMPLES):
            now = s.step(seats, top)
            if k >= BURN_IN:
                p += now
        lp = np.log10(p / SAMPLES)[s.pair]
        lb = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[s.word][s.pair]
        known = (c > 0)[s.word][s.pair]
        docs = s.chunks[-1][2]
        sums = [np.bincount(s.doc, x, docs) for x in (None, known, lb, lp)]
        rows = []
        for r, (chunk, a, b) in zip(table.select(["held", "ids"]).to_pylist(), s.chunks, strict=True):
            there = np.flatnonzero(sums[0][a:b])
            x = [y[a:b][there] for y in sums]
            told_ids = r["ids"] is not None
            rows.append((chunk, _pack(there), _pack(x[0].astype(np.int64)), _pack(x[1].astype(np.int64)), x[2].tobytes(), x[3].tobytes(), r["held"] if told_ids else None, r["ids"]))
        give_back()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())], strict=True)], names=["chunk", "doc", "n", "known", "base", "lp", "held", "ids"])

    return tokens.groupBy("shard").cogroup(told.select("for_shard", "by", "customers", "tokens").groupBy("for_shard")).applyInArrow(run, PARTS)


def summed(parts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) from the sums of all shards."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        ids = next(r["ids"] for r in got if r["ids"] is not None)
        held = np.unpackbits(np.frombuffer(next(r["held"] for r in got if r["held"] is not None), np.uint8))[: len(ids)] == 1
        doc = np.concatenate([_unpack(r["doc"]) for r in got]).astype(np.int64)
        sums = [[_unpack(r[c]) for r in got] for c in ("n", "known")] + [[np.frombuffer(r[c]) for r in got] for c in ("base", "lp")]
        out = [np.bincount(doc, np.concatenate(x), len(ids)) for x in sums]
        return pa.table([pa.array(ids, pa.int64()), pa.array(held), *(pa.array(x.astype(np.int64)) for x in out[:2]), *map(pa.array, out[2:])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return parts.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Scores are base-10 logarithms of the probability of the whole text, its words A-Z lower-cased and one
    end token; ``base_score`` is that of add-half counts. In both all words without a training count are
    one event. Learning leaves out rows whose fold is ``HELD_OUT``; a null id is the empty string there.
    Null text counts as empty: one end token. Repeated rows count and come back as often as given. With
    no training row every token is unknown, with probability one. An empty table gives an empty result;
    other columns are not read. Words and pairs are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = written(words_before(rows), "words")
    every = counts.agg(F.sum("n")).first()[0] or 0
    unit = max(UNIT, every // MOST_SPLIT)
    hot = counts.where((F.col("n") > unit) & (F.col("key") != int(END.astype(np.int64)))).toArrow()  # at most MOST_SPLIT rows
    dropped(counts)
    key, n = hot.column("key").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(key)
    shards = max(8, -(-every // SHARD_TOKENS))
    split = key[order], -(-n[order] // unit)
    asks = written(asked(blocks(rows, shards, split, False), max(3, (shards // 4).bit_length()), seed), "asks")
    collect_shuffles(spark)  # of the pairs
    p1, p2 = (x or 0 for x in asks.agg(F.sum("once"), F.sum("twice")).first())
    told = written(answers(asks), "answers")
    dropped(asks)
    v, n, seated, once, twice = (x or 0 for x in told.agg(*(F.sum(c) for c in ("known", "n", "seated", "once", "twice"))).first())
    discounts = (discount_of(p1, p2), discount_of(once, twice))
    out = summed(scored_blocks(blocks(rows, shards, split, True), told, discounts, n, v, seated, seed))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, base, model): perplexity per token of either part of ``score``'s rows."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(of("base_score").alias("base"), of("score").alias("model"))


def op2_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
