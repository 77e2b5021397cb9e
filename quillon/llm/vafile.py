"""Exact top-k search by vector-approximation files: one-byte cells are scanned for bounds, exact vectors read in the order of these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, table

SCALE = 1024
#: Cells per dimension: one byte.
CELLS = 256
#: Queries of a block, whose vectors and candidates a task holds.
QUERY_BLOCK = 8192
#: Approximations that a task takes at a time.
FILE_ROWS = 8192
#: Bounds of queries by approximations that are held at once.
SCORES = 1 << 21
EXACT = 1 << 53


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) to (vec_id, dim, packed): floor(scale * x) of each component as 64-bit integers.

    Rows whose id or vector is null, or whose vector holds null or non-finite components, are left out. Components are
    held within 2**62 either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for vec_id, x in zip(batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
                if vec_id is None or not x.is_valid:
                    continue
                v = x.values
                if v.null_count:
                    continue
                v = np.floor(v.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(v).all():
                    ids.append(vec_id)
                    dims.append(len(v))
                    packed.append(v.clip(-(2.0**62), 2.0**62).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "packed"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, packed binary")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """vectors(vec_id, dim, packed) to (cls, dim, packed, ids): equal vectors as one, with all ids that can be among k results.

    Equal vectors have equal scores, so of their ids only the k + 1 smallest matter, the query's own among them, and k rows
    of each. Both limits are kept before the shuffle, so a vector that a third of all rows hold costs a few rows a task.
    """
    same = Window.partitionBy("packed", "vec_id").orderBy("dim")
    few = vectors.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")
    least = few.withColumn("_place", F.dense_rank().over(Window.partitionBy("packed").orderBy("vec_id"))).where(F.col("_place") <= k + 1)
    grouped = least.groupBy("packed").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("cls"), "dim", "packed", "ids")


def grids(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least value and width of a cell of each dimension, by number of dimensions: as many rows as there are dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                m = np.frombuffer(b"".join(batch["packed"].filter(pa.array(dims == d)).to_pylist()), np.int64).reshape(-1, d)
                low, high = m.min(0), m.max(0)
                ends[d] = (np.minimum(low, ends[d][0]), np.maximum(high, ends[d][1])) if d in ends else (low, high)
        for d, (low, high) in ends.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(low), pa.array(high)], names=["dim", "at", "low", "high"])

    found = vectors.select("dim", "packed").mapInArrow(run, "dim int, at int, low long, high long").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "at").collect()
    out = {}
    for d in {r["dim"] for r in found}:
        low, high = (np.array([r[c] for r in found if r["dim"] == d], object) for c in ("low", "high"))
        out[d] = low.astype(np.int64), ((high - low) // CELLS + 1).astype(np.int64)
    return out


def approximate(vectors: DataFrame, grid: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(cls, dim, cells): one byte a component, the cell of its dimension's grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for d, x in zip(batch["dim"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                low, width = grid.get(d, (0, 1))
                # the difference may pass 63 bits, but not 64
                cells.append(((np.frombuffer(x, np.int64) - low).view(np.uint64) // np.asarray(width).astype(np.uint64)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch["cls"], batch["dim"], pa.array(cells, pa.binary())], names=["cls", "dim", "cells"])

    return vectors.select("cls", "dim", "packed").mapInArrow(run, "cls long, dim int, cells binary")


class Scan:
    """The queries of a block, and the approximations so far that may be among the k best of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, grid: tuple[np.ndarray, np.ndarray]):
        self.ids, self.k = ids, k
        low, width = (x.astype(np.float64) for x in grid)
        q = vectors.astype(np.float64)
        span = width - 1
        self.step, self.base = (q * width).T, q @ low
        slack = 1 + np.abs(q) @ np.maximum(np.abs(low), np.abs(low + width * CELLS)) * 1e-12  # rounding
        self.take, self.add = np.minimum(q, 0) @ span - slack, np.maximum(q, 0) @ span + slack
        self.held = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.least = np.full(len(ids), -np.inf)

    def scan(self, cls: np.ndarray, cells: np.ndarray) -> None:
        """A score lies between a corner of the cell, less what the cell may take, and plus what it may add."""
        cells, k = cells.astype(np.float64), self.k + 1  # one of them may hold the query alone
        for at in range(0, len(self.ids), max(1, SCORES // max(1, len(cls)))):
            some = slice(at, at + max(1, SCORES // max(1, len(cls))))
            corner = (cells @ self.step[:, some]).T + self.base[some, None]
            if len(cls) >= k:
                nth = np.partition(corner, len(cls) - k, axis=1)[:, len(cls) - k]
                self.least[some] = np.maximum(self.least[some], nth + self.take[some])
            near = corner + self.add[some, None] >= self.least[some, None]
            for i in np.flatnonzero(near.any(1)).tolist():
                found = np.concatenate((self.held[at + i][0], cls[near[i]])), np.concatenate((self.held[at + i][1], corner[i, near[i]]))
                self.held[at + i] = found
                if len(found[0]) > 8 * k:
                    self.prune(at + i)

    def prune(self, i: int) -> None:
        cls, corner = self.held[i]
        if len(corner) > self.k:
            n = len(corner) - self.k - 1
            self.least[i] = max(self.least[i], np.partition(corner, n)[n] + self.take[i])
        stay = corner + self.add[i] >= self.least[i]
        self.held[i] = cls[stay], corner[stay]

    def result(self) -> pa.RecordBatch:
        for i in range(len(self.ids)):
            self.prune(i)
        n = [len(c) for c, _ in self.held]
        cls, corner = (np.concatenate([h[j] for h in self.held]) for j in (0, 1))
        of = np.repeat(np.arange(len(n)), n)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(cls), pa.array(corner + self.take[of]), pa.array(corner + self.add[of])], names=["q", "cls", "lower", "upper"])


def candidates(cells: DataFrame, queries: DataFrame, k: int, grid: dict[int, tuple[np.ndarray, np.ndarray]], parts: int | None = None) -> DataFrame:
    """queries(q, dim, packed) to (q, cls, lower, upper): approximations whose bounds let them be among the k best of a query.

    Approximations are dealt to ranges and queries to blocks. A task has one block and range: it reads the queries, then
    the cells, FILE_ROWS at a time, and passes on what the bounds it has seen do not rule out; the bounds of all ranges rule
    out the rest.
    """
    spark = cells.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    most = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    parts = parts or max(1, min(most, -(-cells.count() // FILE_ROWS)))  # a range passes on k results a query at least, so none is small
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "dim", F.col("q").alias("id"), F.col("packed").alias("data")).withColumn("part", every(parts))
    held = cells.select(F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "dim", F.col("cls").alias("id"), F.col("cells").alias("data")).withColumn("block", every(blocks))
    columns = ["block", "part", "dim", "kind", "id", "data"]
    rows = asked.select(*columns).unionAll(held.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, data, kind, scan = None, [], [], 0, None

        def take(scan: Scan | None) -> Scan | None:
            if ids and kind == 0:
                return Scan(np.array(ids, np.int64), np.frombuffer(b"".join(data), np.int64).reshape(len(ids), group[2]), k, grid.get(group[2], (np.zeros(group[2], np.int64), np.ones(group[2], np.int64))))
            if ids and scan is not None:
                scan.scan(np.array(ids, np.int64), np.frombuffer(b"".join(data), np.uint8).reshape(len(ids), group[2]))
            return scan

        for batch in batches:
            for b, p, d, kd, i, v in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if (b, p, d) != group or kd != kind or len(ids) >= (FILE_ROWS if kind else 1 << 62):
                    scan = take(scan)
                    if (b, p, d) != group:
                        if scan is not None:
                            yield scan.result()
                        group, scan = (b, p, d), None
                    kind, ids, data = kd, [], []
                ids.append(i)
                data.append(v)
        if group and (scan := take(scan)) is not None:
            yield scan.result()

    near = cut(rows.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "dim", "kind").mapInArrow(run, "q long, cls long, lower double, upper double"), "bounds")
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))).where(F.col("_n") <= k + 1)
    least = best.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("lower")).alias("least"))
    return near.join(least, "q").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, held within them."""
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top(query) * top(vectors) * max(1, len(query)) < EXACT:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64)


def numbered(queries: DataFrame) -> DataFrame:
    """Each different query once, with a number q of its own: an id may stand with several vectors."""
    return cut(queries.dropDuplicates(["vec_id", "packed"]).withColumn("q", F.monotonically_increasing_id()), "queries")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None) -> DataFrame:
    """vectors, queries(vec_id, dim, packed) to the k best vectors of each query: query_id, rank, vec_id, score.

    The score is the inner product; a query does not meet rows of its own id, nor vectors of another dimension; ties go to
    the smaller id; equal query rows are answered once; there are fewer than k rows if there are fewer candidates, and none
    for empty tables. Equal vectors are searched as one. Cells are scanned for bounds; exact vectors are joined for what
    these leave alone, and read in the order of the bounds until no later one can reach the kth result.
    """
    queries = numbered(queries)
    reps = cut(distinct_vectors(vectors, k), "distinct")
    grid = grids(reps)
    near = candidates(cut(approximate(reps, grid), "cells"), queries, k, grid, parts)
    asked = queries.select("q", F.col("vec_id").alias("query_id"), F.col("packed").alias("asked"))
    rows = near.join(reps.select("cls", "packed", "ids"), "cls").join(asked, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, scores, ids, done = None, [], [], False
        out: tuple[list, list, list] = ([], [], [])

        def finish() -> None:
            for s, i in zip(scores, ids, strict=True):
                for column, x in zip(out, (query[1], i, s), strict=True):
                    column.append(x)

        for batch in batches:
            for no, q, asked_, upper, packed, own in zip(*(batch[c].to_pylist() for c in ("q", "query_id", "asked", "upper", "packed", "ids")), strict=True):
                if query is None or no != query[0]:
                    if query:
                        finish()
                    query, vector, scores, ids, done = (no, q), np.frombuffer(asked_, np.int64), [], [], False
                if done or (len(scores) == k and upper < scores[-1]):
                    done = True  # in the order of the bounds: no later vector can reach the kth result
                    continue
                s = int(exact_scores(vector, np.frombuffer(packed, np.int64)[None])[0])
                best = sorted([*zip(scores, ids, strict=True), *((s, i) for i in own if i != q)], key=lambda x: (-x[0], x[1]))[:k]
                scores, ids = [x for x, _ in best], [i for _, i in best]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])
            out = ([], [], [])
        if query:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "q").sortWithinPartitions("q", F.desc("upper")).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other embeddings for each whose id is divisible by 100."""
    vectors = cut(quantise(table(spark, sf_dir, "embeddings")), "quantised")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
