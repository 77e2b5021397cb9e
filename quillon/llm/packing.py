"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, table
from quillon.llm.mixing import words

#: Words of a sequence.
CAPACITY = 2048
#: Documents that are packed together, about.
SHARD = 8192
#: A source of this share of all words or less has one piece in a sequence at most, a larger one HOT.
EXCLUSIVE, HOT = 0.125, 8


class Bins:
    """Open bins in the order of what is left in them, each with a bitmap of its full sources and one of its duplicate clusters.

    A source is full with its first piece; one that is allowed more is counted beside the bitmap until then.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: dict[tuple[int, int], int] = {}

    def place(self, size: int, source: int, cluster: int, after: tuple[int, int], most: int = 1) -> tuple[int, int, tuple[int, int]]:
        """(bin, offset, its key before) for a piece with these bits, in the tightest compatible bin at or beyond a key.

        The successor of (size, 0) leaves least; while a bin is full of the source or holds the cluster, the next in order is tried.
        """
        at = bisect_left(self.order, after)
        while at < len(self.order):
            left, k = self.order[at]
            if not (self.sources[k] & source or self.clusters[k] & cluster):
                key = self.order.pop(at)
                break
            at += 1
        else:
            left, k = self.capacity, len(self.sources)
            key = (left, k)
            self.sources.append(0)
            self.clusters.append(0)
        if most > 1:
            self.counts[k, source] = self.counts.get((k, source), 0) + 1
        if most == 1 or self.counts[k, source] >= most:
            self.sources[k] |= source
        self.clusters[k] |= cluster
        if left > size:
            insort(self.order, (left - size, k))
        return k, self.capacity - left, key


def pack_shard(pieces: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Best fit in falling order of size: pieces(size, source, cluster, hot, ...) with bin and offset. Ties by cluster, source and the other columns."""
    keys = [c for c in pieces.columns if c not in ("size", "source", "cluster", "hot")]
    pieces = pieces.sort_values(["size", "cluster", "source", *keys], ascending=[False] + [True] * (2 + len(keys)), kind="stable", na_position="last").reset_index(drop=True)
    source_ids = pd.factorize(pieces["source"], use_na_sentinel=False)[0]
    repeated = pieces.groupby("cluster", dropna=False)["size"].transform("size") > 1
    cluster_ids = pd.factorize(pieces["cluster"].where(repeated), use_na_sentinel=True)[0]
    bins, out, last, at = Bins(capacity), [], None, (0, 0)
    for size, s, c, hot in zip(pieces["size"].tolist(), source_ids.tolist(), cluster_ids.tolist(), pieces["hot"].tolist(), strict=True):
        same = (size, s, c)
        # bins passed over for an equal piece, and the one it took, still hold its cluster or source
        again = same == last and (not hot or c >= 0)
        k, offset, key = bins.place(size, 1 << s, 1 << c if c >= 0 else 0, at if again else (size, 0), HOT if hot else 1)
        last, at = same, key
        out.append((k, offset))
    pieces["bin"], pieces["offset"] = ([x[j] for x in out] for j in (0, 1))
    return pieces


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, size, source, cluster) to (doc_id, piece, start, n_words, bin_id, offset, source): one row a piece.

    Documents longer than a sequence are cut into full pieces and a rest. No sequence holds two pieces of one cluster, nor
    two of a source, or HOT + 1 of one that has more than EXCLUSIVE of all words, whatever the shards are. Documents are dealt to shards of about equal counts by a hash
    that keeps nothing together, so shards stay bounded whatever is hot; null sources are one source; a null cluster is no
    cluster; documents without words get piece 0 and no sequence; equal rows are packed each. Nothing is dropped.
    """
    rows = docs.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "source", "cluster", F.monotonically_increasing_id().alias("_row"))
    rows = cut(rows, "sizes")
    shards = max(1, round(rows.count() / shard))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r["source"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).where(F.col("n") > F.lit(EXCLUSIVE * total)).collect()]  # 1 / EXCLUSIVE rows at most
    hot = F.col("source").isNull() if None in large else F.lit(False)
    hot = F.coalesce(hot | F.col("source").isin([x for x in large if x is not None]), hot)
    pieces = F.ceil(F.col("size") / capacity).cast("int")
    cutup = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cutup = cutup.select(F.pmod(F.xxhash64("_row", "doc_id"), F.lit(shards)).alias("shard"), "doc_id", "source", "cluster", hot.alias("hot"), "_row", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("long") * capacity).alias("size"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard_no = pdf["shard"].iloc[0]
        out = pack_shard(pdf[["size", "source", "cluster", "hot", "_row", "piece", "doc_id"]], capacity)
        out["bin_id"] = (int(shard_no) << 32) + out["bin"]
        out["start"] = out["piece"].astype("int64") * capacity
        return out.rename(columns={"size": "n_words"})[["doc_id", "piece", "start", "n_words", "bin_id", "offset", "source"]]

    schema = f"doc_id {doc_type}, piece int, start long, n_words long, bin_id long, offset long, source string"
    packed = cutup.groupBy("shard").applyInPandas(run, schema)
    empty = rows.where("size <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("offset"), "source")
    return packed.unionByName(empty)


def copies(text: Column) -> Column:
    """Texts that differ in case and white space only are one cluster; null for null."""
    return F.xxhash64(F.md5(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")).cast("binary"))).cast("long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITY words."""
    return pack_stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    text = F.col("text")
    return pack(docs.select("doc_id", words(text).alias("size"), "source", F.when(text.isNotNull(), copies(text)).alias("cluster")))
