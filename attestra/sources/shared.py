"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests), a temporary folder is taken and entered in the
    session, so that all operators of the session use the same one. A cluster must name it: its
    executors would not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="attestra-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestra-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Whether a finished write gives back the disk of its shuffles.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors.

    The shuffles of the write are dropped once it ends; nothing else reads them.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where it comes from fewer and small files; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * (128 << 20):
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
