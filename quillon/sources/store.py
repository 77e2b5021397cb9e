"""Tables that a session writes for itself: cuts of lineage, and indexes that are built once and read by many queries."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only a local session may lack one; it gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base and (made := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = made.get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows, written to the shared folder and read again: the plan starts anew, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the store that holds a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders within one; none if it does not exist."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    fs, at = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells whether files have changed: length and time of all in the newest state."""
    fs, at = file_system(spark, path)
    s = fs.getFileStatus(at)
    own = f"{s.getLen()}:{s.getModificationTime()}"
    return own + "".join(f",{c.getPath().getName()}:{c.getLen()}:{c.getModificationTime()}" for c in (fs.listStatus(at) if s.isDirectory() else []))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores if the scan has fewer parts than these: for costly work on small tables. Large scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
