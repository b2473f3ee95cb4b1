"""Session settings and intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a local run without one gets its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veilframe-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on shared storage, for results that are small
    next to the work behind them (entities next to texts) and are read twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_files(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, where later reads need only some columns."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove all that this application has kept in its checkpoint folder, once its results
    are stored elsewhere.  DataFrames that were made from it can't be used after this."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        for entry in files.listStatus(path) if files.exists(path) else ():
            files.delete(entry.getPath(), True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the input has fewer splits than cores, as
    one small file does.  Inputs with enough splits are left alone: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 4) if df.rdd.getNumPartitions() < cores else df
