"""Near-duplicates by SimHash: fingerprints of word shingles, a byte-position inverted index, verified links, components.

The pipeline's stage asks for Jaccard similarity of shingle sets: fingerprints of the sets find and link near copies by the same
index with a wider limit, verified by the sets; an exact join completes what few differing bits do not tell.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import components, cut, sheltered, table
from quillon.llm.linededup import parity, similar

SEED = 42
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 4
BYTES = 8
#: Shared positional bytes that index one posting list; DISTANCE bits touch DISTANCE bytes at most.
PER_KEY = 3
#: Positions that take part in the index: of BYTES - DISTANCE shared bytes, PER_KEY lie among them, whichever they are.
POSITIONS = DISTANCE + PER_KEY
PIECE = 1 << 19
#: The stage's limit: prints of sets at similarity 0.8 differ in 9.7 bits on average, in 6 of the 40 beyond a shared key; unrelated ones differ in 20 of these.
WIDE = 12
#: The pipeline's stage: texts are near copies at this Jaccard similarity of their shingle sets or more.
SIMILARITY = 0.8
#: One in so many texts tells which shingles are frequent, HEAVY of them at most. They only come last in an order that may be any.
SAMPLED, HEAVY = 16, 1 << 17
#: Texts that are held in a task's verification.
HELD = 512
#: 64-bit words of the bitmap of a set, which tells most dissimilar sets of up to about 2,000 shingles.
BITMAP = [f"b{i}" for i in range(16)]
SLICE = 256


def fingerprint(text: bytes | None, n: int) -> int:
    """SimHash of the n-word shingles of a text in UTF-8, as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()  # bytes: ASCII only, for lower case and white space alike
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - n + 1)
    stops = ends[n - 1 :] if len(words) >= n else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, last, PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : min(at + PIECE, last)].tolist(), stops[at : at + PIECE].tolist(), strict=True)], np.uint64)
        counts += _tally(h)
    return _majority(counts, last)


def _tally(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text in UTF-8 as sorted 64-bit hashes; none without words."""
    words = (text or b"").lower().split()  # as in fingerprint
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - n + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + n]), SEED) for i in range(last)), np.uint64, last)).view(np.int64)


def set_print(shingles: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed 64-bit integer; 0 of an empty one."""
    return _majority(sum((_tally(shingles[at : at + PIECE]) for at in range(0, len(shingles), PIECE)), np.zeros(64, np.int64)), len(shingles))


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """docs(text, ...) with fingerprint long in place of the text. A null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x, n) for x in batch["text"].to_pylist()], pa.int64())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), prints], names=[*rest, "fingerprint"])

    schema = docs.drop("text").select("*", F.lit(0).cast("long").alias("fingerprint")).schema
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def link_runs(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all linked prints within each run of equal keys, without listing all pairs.

    For each offset, the prints so far apart in a run share its positional bytes; those of the other positions are
    tallied, pairs that reach the least count are kept, and their differing bits are counted. A run whose prints have
    become one component is finished; only pairs that join two components are returned.
    """
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order].view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    run = np.repeat(np.arange(len(first)), sizes)
    # rows of runs of two or more
    live = np.flatnonzero(sizes[run] > 1)
    keys, prints, run = keys[live], prints[live], run[live]
    label = np.arange(len(keys))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows, d = np.arange(len(keys)), 1
    end = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)) if len(run) else np.zeros(0, int)
    end = np.repeat(end, np.diff(np.concatenate(([0], end)))) if len(run) else end
    while len(rows := rows[rows + d < end[rows]]):
        apart = rows[label[rows] != label[rows + d]]
        for at in range(0, len(apart), PIECE):
            a = apart[at : at + PIECE]
            x = prints[a] ^ prints[a + d]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            a = a[shared >= BYTES - distance]
            a = a[np.bitwise_count(prints[a] ^ prints[a + d]) <= distance]
            if len(a):
                found.append((a, a + d))
                label = _merge(label, a, a + d)
        d += 1
        if d % 16 == 0:  # runs of one component need no more
            split = np.zeros(run[-1] + 1, bool)
            np.logical_or.at(split, run[1:], (label[1:] != label[:-1]) & (run[1:] == run[:-1]))
            rows = rows[split[run[rows]]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return prints[a].view(np.int64), prints[b].view(np.int64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a and b: smallest row of each."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (deep := label[label] != label).any():
            label[deep] = label[label[deep]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with its component's first node: as many links as nodes at most."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = _merge(np.arange(len(nodes)), places[: len(a)], places[len(a) :])
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join two components, by differing bits: fewer links than nodes."""
    order = np.argsort(np.bitwise_count((a ^ b).view(np.uint64)), kind="stable")
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, kept = list(range(len(nodes))), []
    for k, x, y in zip(order.tolist(), places[order].tolist(), places[len(a) + order].tolist(), strict=True):
        while x != root[x]:
            root[x] = x = root[root[x]]
        while y != root[y]:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            kept.append(k)
    return a[kept], b[kept]


def links(prints: DataFrame, distance: int = DISTANCE, reduce: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = spanning) -> DataFrame:
    """prints(fingerprint long, distinct) to pairs (a, b) that connect whatever links at distance bits or fewer.

    Beyond DISTANCE bits, what shares fewer than PER_KEY of the positional bytes is not found.
    The index is over bytes at positions: prints within DISTANCE bits share BYTES - DISTANCE positional bytes or more, and
    so PER_KEY of the first POSITIONS. Each set of PER_KEY positions with its bytes is a posting list; lists are dealt by
    hash and sorted, and each task tallies, filters and verifies the pairs within its lists. A task returns a spanning
    forest of its links, of such links themselves by `forest`, so the pairs never outnumber the postings.
    """
    byte = [F.shiftrightunsigned("fingerprint", 8 * i).bitwiseAND(F.lit(255)) for i in range(POSITIONS)]
    keys = []
    for k, places in enumerate(combinations(range(POSITIONS), PER_KEY)):
        key = F.lit(k).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            new = np.stack((batch["key"].to_numpy(), batch["fingerprint"].to_numpy()))
            held.append(new)
            if sum(x.shape[1] for x in held) >= PIECE and new[0, 0] != new[0, -1]:  # sorted: keep the last list for later
                rows = np.concatenate(held, axis=1)
                cutoff = np.searchsorted(rows[0], rows[0, -1])
                ends.append(link_runs(rows[0, :cutoff], rows[1, :cutoff], distance))
                held = [rows[:, cutoff:]]
        if held:
            rows = np.concatenate(held, axis=1)
            ends.append(link_runs(rows[0], rows[1], distance))
        if ends:
            a, b = reduce(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    posted = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int) -> DataFrame:
    """docs(doc_id, text, ...) to its columns but the text, with fingerprint long and component_id.

    component_id is the smallest doc_id of the component, null if it has none. Documents with equal fingerprints stand
    for each other in the search for links, so copies are never paired; a null or wordless text has fingerprint 0 and
    links like any other; rows of equal doc_id are kept apart; an empty table gives no rows. Columns of docs that have the
    names of the results give way to them, others pass through. Joins are on the fingerprint, split where it is hot.
    """
    plain, names = sheltered(docs.drop("fingerprint", "component_id"), "doc_id", "text")
    marked = cut(fingerprints(plain, n), "fingerprints")
    classes = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fingerprint")))
    grouped = found.select(F.col("node").alias("fingerprint"), "root").join(classes, "fingerprint")
    whole = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").join(whole, "root", "left")
    named = named.select("fingerprint", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = marked.join(cut(named, "named"), "fingerprint")
    return out.select(*(F.col(v).alias(k) for k, v in names.items() if k != "text"), "fingerprint", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 4-word SimHash and component."""
    docs = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 4)
    return docs.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def heavy_shingles(rows: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles of a sample of rows(_row, text), sorted, HEAVY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, n))], names=["token"])

    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLED)) == 0).select(F.col("text").cast("binary").alias("text"))
    counted = sample.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return np.sort(counted.orderBy(F.desc("df"), "token").limit(HEAVY).toArrow()["token"].to_numpy().astype(np.int64))


def prefixes(rows: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """rows(_row, text, ...) with digest and fingerprint of the shingle set, its size n, its first shingles in an order that has the frequent ones last, and its BITMAP.

    Sets of this similarity share one of the first n - ceil(similarity * n) + 1 of both, whatever the order is.
    """
    shared = rows.sparkSession.sparkContext.broadcast(heavy_shingles(rows, n))  # HEAVY at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            digests, prints, sizes, firsts = [], [], [], []
            sets = [shingle_set(text, n) for text in batch["text"].to_pylist()]
            bits = parity([x.view(np.uint64) for x in sets], 64 * len(BITMAP)).view(np.int64)
            for x in sets:
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                prints.append(set_print(x))
                sizes.append(len(x))
                if len(x) and len(heavy):
                    late = heavy[np.searchsorted(heavy, x).clip(max=len(heavy) - 1)] == x
                    x = np.concatenate((x[~late], x[late]))
                firsts.append(x[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1])
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(BITMAP)))], names=[*rest, "digest", "fingerprint", "n", "first", *BITMAP])

    schema = rows.drop("text").select("*", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("fingerprint"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<long>").alias("first"), *(F.lit(None).cast("long").alias(b) for b in BITMAP)).schema
    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def _fits(similarity: float) -> Column:
    """Whether sizes, and the places from which a shared shingle on the orders agree, allow the similarity of x_ and the other."""
    overlap = F.lit(similarity / (1 + similarity)) * (F.col("x_n") + F.col("n")) - 1e-6
    # nothing that stands before the first shared shingle is shared, so this holds there if the pair is similar
    return (F.least("x_n", "n") >= F.lit(similarity) * F.greatest("x_n", "n") - 1e-6) & (1 + F.least(F.col("x_n") - F.col("x_at"), F.col("n") - F.col("at")) >= overlap)


def _near(similarity: float) -> Column:
    """Whether the bitmaps allow the similarity: sets have as many members that only one holds, at least, as bits differ."""
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(b))) for b in BITMAP), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("x_n") + F.col("n")) + 1e-6


def print_pairs(sets: DataFrame, distance: int = WIDE) -> DataFrame:
    """sets(h, fingerprint) to pairs (a, b): each set with the least one of its print, and that with the one of the nearest linked print. Two pairs a set at most."""
    classes = cut(sets.groupBy("fingerprint").agg(F.min("h").alias("least")), "classes")
    same = sets.join(classes, "fingerprint").where("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    found = cut(links(classes.select("fingerprint"), distance, forest), "links")
    both = found.select(F.col("a").alias("fingerprint"), F.col("b").alias("other")).unionAll(found.select("b", "a"))
    bits = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))).alias("bits")
    nearest = both.groupBy("fingerprint").agg(F.min(F.struct(bits, "other"))["other"].alias("other"))
    named = nearest.join(classes.withColumnRenamed("least", "a"), "fingerprint").join(classes.select(F.col("fingerprint").alias("other"), F.col("least").alias("b")), "other")
    return same.unionByName(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def star_pairs(posts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """posts(token, h, n, at, class) to pairs (a, b): each of a shingle's sets that fits its least one and is of another class, with that."""
    least = posts.groupBy("token").agg(F.min(F.struct("h", "n", "at", "class")).alias("x")).select("token", *(F.col(f"x.{c}").alias(f"x_{c}") for c in ("h", "n", "at", "class")))
    return posts.join(least, "token").where((F.col("class") != F.col("x_class")) & _fits(similarity)).select(F.col("x_h").alias("a"), F.col("h").alias("b")).distinct()


def open_pairs(posts: DataFrame, bitmaps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """posts(token, h, n, at, class) to the pairs (a, b) of different classes that can have this similarity, none lost.

    For each shingle, the sets outside of its main class are held against all: what is joined already yields nothing, and
    of the rest the bitmaps(h, ...) leave hardly more than the similar pairs.
    """
    by_class = posts.groupBy("token", "class").agg(F.count(F.lit(1)).alias("c"))
    main = by_class.groupBy("token").agg(F.max(F.struct("c", "class"))["class"].alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("token", "main")
    held = cut(posts.join(main, "token").join(bitmaps, "h"), "open")
    x = held.where("class <> main").select("token", *(F.col(c).alias(f"x_{c}") for c in ("h", "class", "n", "at", *BITMAP)))
    fits = (F.col("class") != F.col("x_class")) & ((F.col("class") == F.col("main")) | (F.col("x_h") < F.col("h"))) & _fits(similarity) & _near(similarity)
    return x.join(held, "token").where(fits).select(F.least("x_h", "h").alias("a"), F.greatest("x_h", "h").alias("b")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """The written pairs (a, b) of rows(_row, text) whose shingle sets have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def known(row: int, text: bytes) -> np.ndarray:
            if row not in kept:
                kept[row] = shingle_set(text, n)
                if len(kept) > HELD:
                    kept.popitem(last=False)
            return kept[row]

        for batch in batches:
            stay = pa.array([similar(known(a, s), known(b, t), similarity) for a, b, s, t in zip(*(batch[c].to_pylist() for c in ("a", "b", "s", "t")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(stay), batch["b"].filter(stay)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    texts = rows.select("_row", F.col("text").cast("binary").alias("text")).join(wanted, "_row", "left_semi")
    x, y = (texts.select(F.col("_row").alias(k), F.col("text").alias(v)) for k, v in (("a", "s"), ("b", "t")))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), "verified")


def near_copies(rows: DataFrame, sets: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): components of the sets (h, fingerprint, n, first, BITMAP) that have this similarity, read from rows(_row, text) at _row = h.

    SimHash links what has near prints, verified by the sets. An exact set-similarity join does the rest: each shingle that
    begins several sets links them to one by a star; what these leave in several components is compared in full, so large
    groups are never paired and no pair is lost.
    """
    ends = [sets.select(F.col("h").alias(c), F.col("n").alias(f"{p}n"), *(F.col(b).alias(p + b) for b in BITMAP)) for c, p in (("a", "x_"), ("b", ""))]

    def told(pairs: DataFrame) -> DataFrame:
        return verified(cut(pairs.join(ends[0], "a").join(ends[1], "b").where(_near(similarity)).select("a", "b"), "pairs"), rows, n, similarity)

    def classed(posts: DataFrame, pairs: DataFrame) -> DataFrame:
        joined = components(pairs).select(F.col("node").alias("h"), "root")
        return cut(posts.join(joined, "h", "left").select("token", "h", "n", "at", F.coalesce("root", "h").alias("class")), "posts")

    near = told(print_pairs(sets.where("n > 0").select("h", "fingerprint")))
    posts = sets.select("h", "n", F.posexplode("first").alias("at", "token")).withColumn("at", F.col("at") + 1)
    posts = cut(posts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1").select("token", "h", "n", "at"), "posts")
    bitmaps = cut(sets.select("h", *BITMAP).join(posts.select("h").distinct(), "h", "left_semi"), "bitmaps")
    near = near.unionByName(told(star_pairs(classed(posts, near), similarity)))
    rest = verified(cut(open_pairs(classed(posts, near), bitmaps, similarity), "pairs"), rows, n, similarity)
    return components(near.unionByName(rest))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, n: int = 5) -> DataFrame:
    """One document of each group of near copies stays: the first by doc_id, null last, then by row.

    Near copies have SIMILARITY of their n-word shingle sets or more, found by SimHash and then by an exact join, compared
    exactly; groups are components. Texts of equal sets stand for each other, and so do those without words.
    """
    plain, names = sheltered(docs, "doc_id", "text")
    rows = plain.withColumn("_row", F.monotonically_increasing_id())
    marked = cut(prefixes(rows.select("_row", F.col("doc_id").alias("_id"), "text"), n), "prefixes")
    order = F.struct(F.col("_id").isNull(), "_id", "_row")
    sets = cut(marked.groupBy("digest").agg(F.min("_row").alias("h"), F.min(order).alias("m")), "sets")
    starts = marked.select(F.col("_row").alias("h"), "fingerprint", "n", "first", *BITMAP).join(sets.select("h"), "h", "left_semi")
    found = near_copies(rows.select("_row", "text"), starts, n)
    named = sets.join(found.withColumnRenamed("node", "h"), "h", "left")
    stay = named.groupBy(F.coalesce("root", "h")).agg(F.min("m").alias("m")).select(F.col("m._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*(F.col(names[c]).alias(c) for c in docs.columns))
