"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session (tests) gets a folder of its own; a cluster must name one that all share."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tradeloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tradeloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, its lineage ends there, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tradeloom_path = path
    return out


#: Bytes in an Arrow batch sent to a Python worker, whatever the length of its texts; a longer row is a batch of its own.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes. All work in Python sets the same bound, so it does not matter which of several lazy queries was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Tables of fewer bytes, as the optimizer estimates them, are dealt out before work row by row in Python.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work row by row in Python: a table of under ``SMALL_BYTES`` by the plan's estimate (of a scan, by its files) is dealt out to all cores; any other
    stays as its splits are. Nothing is run to find out."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tradeloom_path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def clean(spark: SparkSession) -> int:
    """Delete the tables that queries have written on their way, once no result reads them any more; returns how many. Only folders named ``tradeloom-*`` of the shared folder are touched."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in (store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "tradeloom-*")) or [])]
    return sum(bool(store.delete(x, True)) for x in found)
