"""Row numbers over whole tables without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorenet.storage import written


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``k``, the row's number from 1 in the order of the columns ``order``, which must tell
    rows apart. Range partitions are written and counted; each numbers its own rows from where the ones
    before it end. A row for each partition is summed up on the driver."""
    rows = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    rows = written(rows, "ranges")
    sizes = {r._p: r["count"] for r in rows.groupBy("_p").count().collect()}
    before, n = [], 0
    for p in sorted(sizes):
        before.append((p, n))
        n += sizes[p]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p int, _n long"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.join(starts, "_p").withColumn("k", F.col("_n") + place).drop("_p", "_n")
