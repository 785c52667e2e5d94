"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The Parquet table of that name under root, a file or a folder."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the session names none, one is made and set on a single machine (master local); on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet. Who needs it no more removes it with remove()."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not there: it is written beside its place and then renamed."""
    fs, where = _file_system(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few files for work that costs more than moving its rows: in as many partitions as the cluster has cores.

    Scans that already have as many partitions stay as they are, so that a large table is never shuffled by this. Only for
    scans with projections and filters: asking a plan with joins for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
