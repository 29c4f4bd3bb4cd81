"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files a core of the cluster of a table that is written with few=True, at most.
FILES_A_CORE = 6


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset and all run in this machine (tests) a
    temporary one. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexisift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nobody else has."""
    return f"{shared_dir(spark)}/lexisift/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, codec: str = "snappy", few: bool = False) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again, which cuts its lineage.

    The files outlive a lost executor. The path stands in the frame's attribute ``stash_path``. few: for tables of ids, hashes
    and sums; a task writes several partitions one after the other, so that many small ones do not become as many files, for
    each of which an executor without Hadoop's native library starts three processes (chmod). Not for functions that ask for
    their partition's number.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism)
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that stash() wrote and nobody reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
