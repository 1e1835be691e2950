"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorenet.llm import exact_dedup, kn_quality, packing, simhash_index
from scorenet.storage import dropped, written

STAGES = [
    ("quality classifier", kn_quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("simhash near-dedup", simhash_index.stage),
    ("packing", packing.stage),
]

#: SQL can't express the classifier's model, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            dropped(before)
        docs = before = after
    return docs
