"""Files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{shared_folder(spark)}/docloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back; the files go when the application ends.

    A lost executor loses nothing of it, and what Spark draws anew when it runs a plan again stays as it was.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    if path := getattr(df, "_docloom_path", None):
        where, files = _at(df.sparkSession, path)
        files.delete(where, True)
