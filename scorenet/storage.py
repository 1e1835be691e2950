"""Tables and files that every executor can reach.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and Spark
runs in this one process, as in tests, a folder of this machine is made, one for each application, and set
as its checkpoint folder.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made here, by application: the setting itself can't be changed in a running session.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, a new temporary one where that is unset in local mode; on a
    cluster executors would not see each other's files there, which raises ``ValueError``."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not is_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="scorenet-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        _OWN[context.applicationId] = f"file://{own}"
    return _OWN[context.applicationId]


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/scorenet/{uuid.uuid4().hex}/{tag}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what ``fresh_path`` named, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here and the rows
    outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scorenet_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_scorenet_path", None)
        if path:
            drop_path(t.sparkSession, path)


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan reads any more; its cleaner waits for the driver's JVM
    to collect garbage, which may not happen for long. Python's own references are given up a moment later
    than its objects."""
    for _ in range(2):
        gc.collect()
        time.sleep(1.0)
        spark.sparkContext._jvm.System.gc()
