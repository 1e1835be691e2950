"""The classifier on labels that it has not seen, and its model against a plain one."""

import math
from collections import Counter

from moved import moved
from pyspark.sql import functions as F

from scorenet.llm import kn_quality
from scorenet.llm.text_units import nearly_among

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = F.pmod(F.xxhash64(F.col("doc_id") + 7), F.lit(3)) > 0
    out = kn_quality.classify(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").where("_perplexity is not null")
    got = {r.quality: (r.n, r.kept) for r in out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("_keep").alias("kept")).collect()}
    print("trusted kept", got[1], "junk kept", got[0])
    assert got[1][1] >= 0.95 * got[1][0] and got[0][1] <= 0.2 * got[0][0]


def test_order_and_repetition_count(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on the mat and saw a dog {i % 7} run over the hill", "en") for i in range(80)] + [(100, "the cat sat on the mat", "en"), (101, "the the the the the the", "en"), (102, "mat the on sat cat the", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r._perplexity for r in kn_quality.classify(docs, labels).collect()}
    assert got[100] < got[102] and got[100] < got[101]


def test_model_against_plain_counts(spark):
    """Probabilities of a small model by the formula of interpolated modified Kneser-Ney."""
    texts, longest = ["ab ab abc", "bca bb", "ab cc"], 2
    model = kn_quality.trained_model(spark.createDataFrame([(t,) for t in texts], "text string"), longest=longest)
    top: Counter = Counter()
    for t in texts:
        s = "^" + t + "$"
        for i in range(1, len(s)):
            top[(s[max(0, i - longest) : i], s[i])] += 1
    levels = {longest: top}
    # The place after the start mark has a short context, which stands for all its lengths.
    for k in range(longest - 1, -1, -1):
        seen = {(h[-k:] if k else "", h, c) for (h, c) in levels[k + 1]}
        levels[k] = Counter((h, c) for h, _, c in seen)

    def p(h, c):
        out = 1 / (len({x for _, x in levels[0]}) + 1)
        for k in range(longest + 1):
            n = Counter(levels[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            off = [min(max(0.05, d), 0.95 * i) for i, d in ((1, 1 - 2 * y * n[2] / n[1] if n[1] else 0.5), (2, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0), (3, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5))]
            x = h[-k:] if k else ""
            rows = {d: m for (g, d), m in levels[k].items() if g == x}
            if rows:
                cut = {d: off[min(m, 3) - 1] for d, m in rows.items()}
                out = ((rows[c] - cut[c]) if c in rows else 0) / sum(rows.values()) + sum(cut.values()) / sum(rows.values()) * out
        return out

    for text in ("ab", "abc b", "zb"):
        s = "^" + text + "$"
        want = sum(math.log(p(s[max(0, i - longest) : i], s[i])) for i in range(1, len(s)))
        logs, size = model.text_logs([text.encode()])
        assert size[0] == len(text) + 1 and math.isclose(logs[0], want, rel_tol=1e-9)


def test_every_label_counts(spark, monkeypatch):
    """The model learns from half of the trusted documents, the thresholds come from all others; n-grams that a
    task hands on in parts count in full."""
    docs = spark.createDataFrame([(i, f"text {i} of {i % 13}", "en") for i in range(20_000)], "doc_id long, text string, lang string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    seen = {}
    model, limits = kn_quality.trained_model, kn_quality.thresholds
    monkeypatch.setattr(kn_quality, "trained_model", lambda t: seen.update(train=t.count()) or model(t))
    monkeypatch.setattr(kn_quality, "thresholds", lambda t: seen.update(rest={r.quality: r["count"] for r in t.groupBy("quality").count().collect()}) or limits(t))
    kn_quality.classify(docs, labels)
    assert 8_900 < seen["train"] <= 9_000 and seen["rest"] == {0: 2_000, 1: 18_000 - seen["train"]}
    monkeypatch.setattr(kn_quality, "GRAMS_HELD", 50)
    import pyarrow as pa

    texts = pa.table({"text": [f"some text {i % 7} {i}" for i in range(1500)]})
    parts = [r for b in kn_quality._gram_counts(iter(texts.to_batches(400)), 5) for r in [b.num_rows]]
    counts = sum(sum(b.column("c").to_pylist()) for b in kn_quality._gram_counts(iter(texts.to_batches(400)), 5))
    assert len(parts) > 1 and counts == sum(len(t) + 1 for t in texts.column("text").to_pylist())


def test_other_texts_are_not_shuffled(spark):
    """Texts without labels are not shuffled to meet labels that are too many to broadcast, and no table of
    the model is left behind."""
    import glob
    import random

    from scorenet.storage import shared_dir

    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "ab cd" if i % 10 == 0 else rng.randbytes(4000).hex(), "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.range(0, 600, 10).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    left, least = f"{shared_dir(spark).removeprefix('file://')}/scorenet/*/model*", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before, there = moved(spark), set(glob.glob(left))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert kn_quality.classify(docs, labels).count() == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert moved(spark) - before < 1_000_000 and set(glob.glob(left)) == there  # texts: 4,320,000 characters


def test_nearly_among(spark):
    rows = spark.createDataFrame([(None,), *((i,) for i in range(-3000, 20_000))], "doc_id long")
    keys = spark.range(-500, 500, 2).select(F.col("id").alias("doc_id"))
    got = [r.doc_id for r in nearly_among(rows, keys, "doc_id", 500).collect()]
    rest = [r.doc_id for r in nearly_among(rows, keys, "doc_id", 500, "left_anti").collect()]
    assert set(range(-500, 500, 2)) <= set(got) and len(got) < 4000
    assert len(got) + len(rest) == 23_001 and not set(got) & set(rest)
    assert nearly_among(rows, keys.limit(0), "doc_id", 0).count() == 0
