"""Exact dedup with a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is hashed, pre-aggregated to one row for
each digest, deduplicated against the index by a sort-merge anti-join, and what is new is appended.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import join_hot
from scorenet.storage import drop_path, dropped, fresh_path, written

SPACE_RUN = r"[\x20\x09-\x0D]+"
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


class DigestIndex:
    """Digests seen so far with the row that stands for each: (digest, batch, keep_id, first_size).

    ``path`` may hold an index of an earlier session; its number of buckets is kept beside the files, and
    opening it with another raises ``ValueError``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets_*")
        fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName().rpartition("_")[2] for x in fs.globStatus(mark) or []]
        self.buckets = buckets or int(found[0] if found else spark.conf.get("spark.sql.shuffle.partitions"))
        if found not in ([], [str(self.buckets)]):
            raise ValueError(f"the index at {path} has {', '.join(found)} buckets, not {self.buckets}")
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets_{self.buckets}"))
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, batch STRING, keep_id BIGINT, first_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append the digests of ``rows`` (digest, id, row, n) that the index lacks, as of ``batch``.
        Returns the groups (digest, least, size), one for each digest; ``least`` has the least id, of its
        rows the least row, and n. A batch whose digests were appended before it broke off adds none."""
        groups = written(rows.groupBy("digest").agg(F.min(F.struct("id", "row", "n")).alias("least"), F.sum("n").alias("size")), "groups")
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", F.lit(batch).alias("batch"), F.col("least.id").alias("keep_id"), F.col("size").alias("first_size"))
        new = new.repartition(self.buckets, "digest")
        new.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return groups

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


def dedup_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    ``batch`` names the batch, by default one of its own: rows given again under another name are all
    dropped, and a batch that broke off can be run again under its name with the result it would have
    had. Null text counts as empty. Of equal texts the least id stays; a null id is less than any. Rows
    that repeat both id and text are told apart by their place, so exactly one stays. Texts that other
    batches brought before are all dropped, with the keep_id found there, and group_size counts the
    batch's rows and those the index saw first. An empty table gives an empty result; other columns are
    not read. A digest that holds a great share of the rows is pre-aggregated and its one index row
    broadcast."""
    batch = batch or uuid.uuid4().hex
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))
    rows = written(rows.select("digest", "id", F.monotonically_increasing_id().alias("row")), "digests")
    groups = index.add(rows.withColumn("n", F.lit(1).cast("long")), batch)
    known = groups.join(index.table().hint("merge"), "digest")
    own = F.col("batch") == batch
    known = written(
        known.select("digest", "keep_id", F.when(own, F.col("least.row")).alias("stay"), F.when(own, F.col("size")).otherwise(F.col("size") + F.col("first_size")).alias("group_size"), "size"),
        "known",
    )
    dropped(groups)
    hot = known.where(F.col("size") >= max(2, rows.count() // HOT_SHARE)).drop("size")
    out = join_hot(rows, known.drop("size"), "digest", hot)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("stay"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest_index"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = dedup_batch(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.drop()  # the result reads tables of its own
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with all their columns.

    The digests' winners come from the index; the texts are shuffled once, to meet them, and once more
    only those of winners that repeat both id and text."""
    index = fresh_index(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest(F.col("text")).alias("digest"))
    rows = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.lit(0).cast("long"))
    groups = index.add(rows, "stage")
    index.drop()
    win = groups.select(F.col("digest").alias("_win_digest"), F.col("least.id").alias("_win_id"), (F.col("least.n") > 1).alias("_again"))
    keyed = docs.withColumn("_own_digest", digest(F.col("text")))

    def met(some: DataFrame) -> DataFrame:
        return keyed.join(some, (F.col("_own_digest") == F.col("_win_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_win_id")), "left_semi")

    again = win.where("_again")
    if again.isEmpty():
        return met(win).select(*docs.columns)
    return met(win.where("not _again")).unionByName(met(again).dropDuplicates(["_own_digest"])).select(*docs.columns)


ORACLE = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
