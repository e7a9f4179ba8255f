"""Work tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a work table in spark.checkpoint.dir. Where that is unset, a local master (all on one machine) gets a
    folder of its own; on a cluster it is an error, as executors don't share a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="maskline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: cuts the lineage, and outlives executors."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to at least as many tasks as there are cores: for work by which a row costs much more than its move. A table of as
    many parts or more, and of half as many files, stays where it is: of one in fewer files a few row groups, each read by one task, may hold all rows."""
    if df.isStreaming:
        return df
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    files = len(df.inputFiles()) or parts
    return df if parts >= cores and 2 * files >= cores else df.repartition(max(cores, parts))


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.work_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
