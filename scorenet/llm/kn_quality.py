"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is trained on half of the trusted documents, over their characters, words parted by one space;
contexts run over the ends of words, so that order and repetition count. Counts, continuation counts and
context totals are DataFrames sharded by hash and joined level by level into interpolated probabilities; the
finished table of the distinct n-grams, which are far fewer than the characters, goes to the executors. A
document's perplexity is compared with a threshold for its language, taken from quantiles of all labelled
documents that the model has not seen. As that of a short text is little more than chance, it is first drawn
towards the language's mean, as if the text had some more characters of mean perplexity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from scorenet.llm.backoff import BackoffTable, KeyTable, gram_key, hashed, mixed, preceding
from scorenet.llm.text_units import forget_encoders, give_back, nearly_among, rows_of
from scorenet.storage import collect_shuffles, dropped, written

LONGEST = 5  # characters of context
TRUSTED_QUANTILE, JUNK_QUANTILE = 0.998, 0.01
PRIOR_CHARS = 100
LEAST_LABELS = 30  # labels from which a language gets a threshold of its own
AT_ONCE = 400_000  # bytes of text that are scored at once
GRAMS_HELD = 1_000_000  # distinct n-grams that a task counts before it hands them on


def _plain(text: str | None) -> bytes:
    """A text's words parted by single spaces; null counts as empty."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


def _portions(texts: list[bytes]):
    """Slices of texts that have AT_ONCE bytes together, or one text."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if hi > lo and size + len(t) > AT_ONCE:
            yield texts[lo:hi]
            lo, size = hi, 0
        size += len(t)
    if texts:
        yield texts[lo:]


def _gram_counts(batches, longest: int):
    """Rows (what stands 1 to ``longest`` places before, character, count) of a task's texts, each n-gram once
    for about ``GRAMS_HELD`` of them."""
    names = [*(f"b{k}" for k in range(1, longest + 1)), "ch", "c"]
    held: list = []

    def fold():
        keys, rows, n = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
        keys, at, same = np.unique(keys, return_index=True, return_inverse=True)
        held[:] = [(keys, rows[:, at], np.bincount(same, n).astype(np.int64))]

    def out():
        (_, rows, n) = held.pop()
        for i in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([*(pa.array(r[i : i + 100_000].astype(np.int32)) for r in rows), pa.array(n[i : i + 100_000])], names=names)

    for (texts,) in rows_of(batches, 500):
        for part in _portions([t for t in map(_plain, texts) if t]):
            _, ch, before = preceding(part, longest)
            with np.errstate(over="ignore"):
                keys, at, n = np.unique(gram_key(hashed(before)[longest], ch), return_index=True, return_counts=True)
            held.append((keys, np.vstack([before[:, at], ch[at]]), n))
            if sum(len(h[0]) for h in held) > 2 * GRAMS_HELD:
                fold()
                if len(held[0][0]) > GRAMS_HELD:
                    yield from out()
    if held:
        fold()
        yield from out()


def _context(rows: pa.Table, names: list[str]) -> np.ndarray:
    return hashed(np.vstack([np.zeros((0, rows.num_rows), np.uint32), *(rows.column(n).to_numpy().astype(np.uint32) for n in names)]))[len(names)]


def trained_model(trusted: DataFrame, text_col: str = "text", longest: int = LONGEST) -> BackoffTable:
    """The model of the texts in ``trusted``; an empty table gives the uniform model."""
    names = [f"b{k}" for k in range(1, longest + 1)]
    rows = trusted.select(F.col(text_col).cast("string")).mapInArrow(lambda batches: _gram_counts(batches, longest), ", ".join(f"{n} int" for n in [*names, "ch"]) + ", c long")
    level = written(rows.groupBy(*names, "ch").agg(F.sum("c").alias("c")), f"grams{longest}")
    levels = {longest: level}
    for k in range(longest - 1, -1, -1):  # how many characters stand before a gram
        level = written(level.groupBy(*names[:k], "ch").agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
        levels[k] = level
    letters = levels[0].count()
    below = None
    tables, weights = [], []
    for k in range(longest + 1):
        level, own = levels[k], names[:k]
        n1, n2, n3, n4 = level.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        off = [min(max(0.05, d), 0.95 * i) for i, d in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        cut = F.when(F.col("c") == 1, off[0]).when(F.col("c") == 2, off[1]).otherwise(off[2])
        totals = level.groupBy(*own).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed")).where("total is not null")
        totals = totals.select(*own, "total", (F.col("freed") / F.col("total")).alias("gamma"))
        joined = level.join(totals, own) if k else level.join(F.broadcast(totals))  # one row
        if k:
            joined = joined.join(below.withColumnRenamed("p", "_p"), [*own[:-1], "ch"])
        base = F.col("_p") if k else F.lit(1.0 / (letters + 1))
        lower, below = below, written(joined.select(*own, "ch", ((F.col("c") - cut) / F.col("total") + F.col("gamma") * base).alias("p")), f"model{k}")
        with np.errstate(over="ignore"):
            got = below.toArrow()  # a row for each distinct n-gram
            tables.append(KeyTable(gram_key(_context(got, own), got.column("ch").to_numpy()), got.column("p").to_numpy()))
            got = totals.select(*own, "gamma").toArrow()
            weights.append(KeyTable(mixed(_context(got, own)), got.column("gamma").to_numpy()))
        dropped(level, *([lower] if k else []))
    dropped(below)
    return BackoffTable(tables, weights, 1.0 / (letters + 1))


def scored(docs: DataFrame, shipped: Broadcast[BackoffTable], text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, ``_log`` (natural logarithm of the whole text's probability) and
    ``_chars`` (with the end mark); both null for a text without words."""
    names = [*docs.columns, "_log", "_chars"]
    at = names.index(text_col)

    def run(batches):
        forget_encoders()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = [_plain(t) for t in part.column(at).to_pylist()]
                got = [x for some in _portions(texts) for x in zip(*(y.tolist() for y in shipped.value.text_logs(some)), strict=True)]
                got = [x if t else (None, None) for x, t in zip(got, texts, strict=True)]
                logs, sizes = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logs, pa.float64()), pa.array(sizes, pa.int64())], names=names)
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_log", DoubleType()).add("_chars", LongType()))


def steadied(mean: Column) -> Column:
    """Perplexity as if the text had PRIOR_CHARS more characters of the logarithm ``mean``."""
    return F.exp(-(F.col("_log") + PRIOR_CHARS * mean) / (F.col("_chars") + PRIOR_CHARS))


def thresholds(labelled: DataFrame) -> list[tuple[str | None, float, float]]:
    """(lang, mean logarithm of a character, threshold) from labelled documents (lang, quality, _log,
    _chars), and a row of null lang for all languages, which also serves those with too few labels.
    Between the trusted documents' high quantile and the junk's low one if these are apart, else the
    trusted quantile."""
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    labelled = written(labelled.where("_log is not null").select("lang", "quality", "_log", "_chars"), "calibration")
    means = labelled.where(good).groupBy("lang").agg(F.sum("_log").alias("l"), F.sum("_chars").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # a row for each language of the sample
    own = {r.lang: r.l / r.c for r in means if r.lang is not None and r.n >= LEAST_LABELS}
    every = sum(r.l for r in means) / max(1, sum(r.c for r in means))
    out = []
    for lang, mean in [(None, every), *own.items()]:
        rows = labelled if lang is None else labelled.where(F.col("lang") == lang)
        x = steadied(F.lit(mean))
        high, low, n_bad = rows.agg(F.percentile_approx(F.when(good, x), TRUSTED_QUANTILE, 10_000), F.percentile_approx(F.when(bad, x), JUNK_QUANTILE, 10_000), F.count_if(bad)).first()
        if high is None:
            high = math.inf
        elif n_bad >= LEAST_LABELS and low > high:
            high = math.sqrt(low * high)
        out.append((lang, mean, high))
    dropped(labelled)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with all its columns and (_perplexity, _steadied, _threshold, _keep) for every row.

    Trusted documents are those with label quality 1. Half of them, those with the lesser hashes of their ids
    (never more than half), train the model; the thresholds come from all others and all of quality 0. All
    these count with their whole texts. ``_perplexity`` is per character of the whole text; a text is kept if
    that, drawn towards the mean (``_steadied``), is at most the threshold of its language, or of all languages
    if that has too few labels, is null or unknown. Null and empty texts have no perplexity and are not kept.
    Without labels every text that has words is kept. Labels with a null id or quality count for nothing,
    repeated ones once. Repeated rows repeat; an empty table gives an empty result."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = written(marks.select(F.col("doc_id").cast("long"), "quality", F.xxhash64(F.col("doc_id").cast("string")).alias("spread")), "marks")
    middle = marks.where("quality = 1").agg(F.percentile_approx("spread", 0.5, 10_000)).first()[0]
    trains = (F.col("quality") == 1) & (F.col("spread") < (-(2**63) if middle is None else middle))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def marked(some: DataFrame) -> DataFrame:
        """The texts of ``some`` marks; others are not shuffled to meet them."""
        return nearly_among(texts, some, "doc_id", some.count()).join(some, "doc_id")

    model = spark.sparkContext.broadcast(trained_model(marked(marks.where(trains).select("doc_id"))))
    collect_shuffles(spark)  # of the n-grams
    limits = thresholds(scored(marked(marks.where(~trains).select("doc_id", "quality")), model))
    dropped(marks)
    (_, mean, rest), *own = limits
    table = spark.createDataFrame(own, "_lang string, _mean double, _limit double")
    out = scored(docs, model, text_col).join(F.broadcast(table), F.col(lang_col).cast("string") == F.col("_lang"), "left")
    limit, steady = F.coalesce("_limit", F.lit(rest)), steadied(F.coalesce("_mean", F.lit(mean)))
    return out.select(*docs.columns, F.exp(-F.col("_log") / F.col("_chars")).alias("_perplexity"), steady.alias("_steadied"), limit.alias("_threshold"), F.coalesce(steady <= limit, F.lit(False)).alias("_keep"))


def op5_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_steadied").alias("steadied"), F.col("_threshold").alias("threshold"), F.col("_keep").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("_keep").select(*docs.columns)
