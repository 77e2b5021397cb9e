"""Freshness: change batches, the latest state per path, the overlay over a base, compaction, and the stream that feeds it.

overlay(rel_path, generation, seq, tombstone, text). A higher generation wins; within one, the later row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import grams
from quillon.sources import store

MOST_ENTRIES = 512


def normal_path(c):
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def apply_batch(changes: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """changes(kind, rel_path, new_rel_path, generation, seq) to overlay rows.

    create and modify take the current text, or leave a tombstone if the corpus has none; delete leaves a tombstone; a rename
    leaves one and makes an entry. Paths within an index folder are ignored.
    """
    gone = lambda p: F.struct(normal_path(p).alias("rel_path"), F.lit(True).alias("tombstone"))
    live = lambda p: F.struct(normal_path(p).alias("rel_path"), F.lit(False).alias("tombstone"))
    kind, path, new = F.lower("kind"), F.col("rel_path"), F.col("new_rel_path")
    rows = F.when(kind == "delete", F.array(gone(path))).when(kind == "rename", F.array(gone(path), live(new))).otherwise(F.array(live(path)))
    out = changes.select("generation", "seq", F.explode(rows).alias("x")).select("x.rel_path", "generation", "seq", "x.tombstone")
    out = out.where(~F.col("rel_path").rlike(r"(^|/)\.index/"))
    if corpus is None:
        return out
    now = corpus.select("rel_path", F.col("text"), F.lit(True).alias("_there"))
    joined = out.join(now, "rel_path", "left")
    dead = F.col("tombstone") | F.col("_there").isNull() | F.col("text").isNull()
    return joined.select("rel_path", "generation", "seq", dead.alias("tombstone"), F.when(~dead, F.col("text")).alias("text"))


def with_grams(rows: DataFrame) -> DataFrame:
    """Overlay rows with the grams of path and text, so that a search can pass over entries as it does over the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = grams.Cutter()
        for batch in batches:
            found = [list(cutter.document(p, t)[0]) for p, t in zip(batch["_path"].to_pylist(), batch["_text"].to_pylist(), strict=True)]
            rest = [c for c in batch.schema.names if c not in ("_path", "_text")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(found, pa.list_(pa.string()))], names=[*rest, "grams"])

    schema = rows.select("*", F.lit(None).cast("array<string>").alias("grams")).schema
    return rows.withColumns({"_path": grams.raw_tokens(F.col("rel_path")), "_text": grams.raw_tokens(F.col("text"))}).mapInArrow(run, schema)


def latest(overlay: DataFrame) -> DataFrame:
    """One row per path: the largest (generation, seq), by partial aggregates."""
    rest = [c for c in overlay.columns if c not in ("rel_path", "generation", "seq")]
    newest = overlay.groupBy("rel_path").agg(F.max(F.struct("generation", "seq", *rest)).alias("m"))
    return newest.select("rel_path", "m.*")


def stats(overlay: DataFrame) -> DataFrame:
    """Live entries and tombstones, of all rows and of the latest."""
    count = lambda df, p: df.agg(F.count_if(~F.col("tombstone")).alias(f"{p}live"), F.count_if("tombstone").alias(f"{p}tombstones"))
    return count(overlay, "").crossJoin(F.broadcast(count(latest(overlay), "latest_")))


def merged(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The base without shadowed paths, and the live entries: what a search sees."""
    now = latest(overlay)
    return base.select("rel_path", "text").join(now, "rel_path", "left_anti").unionByName(now.where("not tombstone").select("rel_path", "text"))


def next_generation(overlay: DataFrame) -> int:
    return (overlay.agg(F.max("generation")).first()[0] or 0) + 1


def needs_compaction(overlay: DataFrame, most: int = MOST_ENTRIES) -> bool:
    return overlay.limit(most).count() >= most


def coalesce_pending(changes: DataFrame) -> DataFrame:
    """The last change of each path within a batch."""
    last = Window.partitionBy("rel_path").orderBy(F.desc("generation"), F.desc("seq"))
    return changes.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def reconcile(now: DataFrame, then: DataFrame) -> DataFrame:
    """(rel_path, kind) from snapshots (rel_path, modified_unix_secs): new or changed files, and those that are gone."""
    changed = now.join(then, ["rel_path", "modified_unix_secs"], "left_anti").select("rel_path", F.lit("modify").alias("kind"))
    return changed.unionByName(then.join(now, "rel_path", "left_anti").select("rel_path", F.lit("delete").alias("kind")))


def is_stale(manifest: dict, head: str, branch: str) -> bool:
    return manifest.get("head") != head or manifest.get("branch") != branch


def start(changes: DataFrame, path: str, checkpoint: str, corpus: Callable[[], DataFrame] | None = None, every: str | None = None):
    """Feed a stream of changes(kind, rel_path, new_rel_path, generation) into overlay tables, one folder a batch.

    A batch is written under its id, so one that is run again after a failure replaces itself. `every` is the debounce, such
    as "5 seconds"; without it the stream drains what is there and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("seq", F.monotonically_increasing_id())
        apply_batch(rows, corpus() if corpus else None).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _batches(spark: SparkSession, path: str) -> tuple[tuple[int, int], list[int]]:
    """The last batch that is folded, or -1, with the count of foldings, and the complete batches after it."""
    whole = lambda at, mark: [n[len(mark) :] for n in store.folders(spark, at) if n.startswith(mark) and store.complete(spark, f"{at}/{n}")]
    folded = max(((int(b), int(k)) for b, _, k in (n.partition(",") for n in whole(f"{path}/folded", "upto="))), default=(-1, 0))
    return folded, sorted(int(b) for b in whole(path, "batch=") if int(b) > folded[0])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The overlay that the stream has written: the folded rows and the batches after them; later batches come later within a generation.

    Batches that were not written to their end are left out, so a reader never sees part of one.
    """
    (last, turn), after = _batches(spark, path)
    parts = [spark.read.parquet(f"{path}/folded/upto={last},{turn}")] if last >= 0 else []
    parts += [spark.read.parquet(f"{path}/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in after]
    if not parts:
        return spark.createDataFrame([], "rel_path string, generation long, tombstone boolean, text string, seq struct<batch:long,seq:long>")
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    return rows.withColumn("seq", F.struct("batch", "seq")).drop("batch")


def compact(spark: SparkSession, path: str, empty: bool = False) -> None:
    """Fold the batches so far into the latest row of each path, in a folder of its own that counts once it is complete.

    What was folded is removed after that, so a reader or a failure in between sees the old state or the new. With empty,
    nothing is kept of them: the base has taken them in.
    """
    (last, turn), after = _batches(spark, path)
    if not after and (last < 0 or not empty):
        return
    rows = latest(read(spark, path))
    name = f"upto={after[-1] if after else last},{turn + 1}"
    folded = (rows.limit(0) if empty else rows).select(*(c for c in rows.columns if c != "seq"), "seq.batch", "seq.seq")
    folded.write.mode("overwrite").parquet(f"{path}/folded/{name}")
    for b in after:
        store.remove(spark, f"{path}/batch={b}")
    for other in store.folders(spark, f"{path}/folded"):
        if other != name:
            store.remove(spark, f"{path}/folded/{other}")


def compact_base(spark: SparkSession, base: DataFrame, path: str, target: str) -> DataFrame:
    """Write the base with the overlay taken in to a new folder, and empty the overlay; returns the new base."""
    merged(base, read(spark, path)).write.parquet(target)
    compact(spark, path, empty=True)
    return spark.read.parquet(target)
