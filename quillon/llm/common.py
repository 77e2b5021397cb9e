"""What the training-data operators share: table access, written cuts of the lineage, and distributed union-find."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the query contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: the plan starts anew there, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its other columns named c0, c1, ..., and the new name of each column: extra columns then clash with nothing."""
    names = {c: c if c in used else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def drop(*frames: DataFrame | None) -> None:
    """Remove the written tables of frames that came from cut() and are read no more."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected components by contraction: edges(a long, b long) to (node, root).

    Each round hooks every node to the smallest of its neighbours, follows the hooks by doubling until all point to a
    root, and relabels the remaining edges. A round leaves half of the nodes at most and the doublings of a round grow
    with the logarithm of its longest chain. Every step is an aggregate or an equi-join, whose hot keys are combined
    before the shuffle or split by adaptive execution; rounds are written to the shared folder. Nulls and loops are
    ignored; repeated edges count once; nodes without an edge are not returned. The root is some node of the component.
    """
    pairs = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        hook = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "hooks")
        while True:
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(hook.join(to, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumps")
            drop(hook)
            hook = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        ends = [hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        left = links.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        rest = cut(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if found is None:
            now = hook
        else:
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            now = cut(found.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found")
            drop(found, hook)
        drop(links)
        links, found = rest, now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
