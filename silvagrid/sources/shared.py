"""Tables written to the folder that all machines share: this cuts a plan's lineage, and lost executors don't
take them along."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a folder of its own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="silvagrid-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: this cuts the lineage, survives lost
    executors, and is removed when the session ends (or by dropped())."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/silvagrid-{uuid.uuid4().hex}"
    p, fs = _path(spark, to)
    df.write.option("compression", "zstd").parquet(to)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(to)
    out._silvagrid_path = to
    return out


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """saved(), for small results of wide shuffles: rows are dealt anew by some columns, so that the number of files
    follows the bytes (adaptive execution) and is no more than the cores, whatever the number of shuffle partitions.
    Where Hadoop has no native code, each file on a local disk costs its executor several child processes (chmod)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return saved(df.hint("rebalance", *(F.col(c) for c in by)).coalesce(cores))


def dropped(df: DataFrame) -> None:
    """Remove a table of saved() that nothing will read any more."""
    if to := getattr(df, "_silvagrid_path", None):
        p, fs = _path(df.sparkSession, to)
        fs.delete(p, True)
