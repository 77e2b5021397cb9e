"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, one line kept per component."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import components, cut, drop, sheltered, table

#: Code points of a shingle; a shorter line is one shingle.
SHINGLE = 8
SIMILARITY = 0.8
#: A pair at the threshold shares all rows of one of the bands with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.997.
BANDS, ROWS = 8, 3
#: Buckets of so many lines or fewer yield all their pairs; larger ones a star and a chain, and cells for what these leave apart.
SMALL = 8
#: Lines of a bucket that meet as many others in a cell, and bits of the bitmap that tells most dissimilar lines.
BLOCK, BITS = 4096, 1024
#: Pairs whose bitmaps are compared at once.
HELD = 1 << 18
FLUSH = 1 << 20
#: Lines that are hashed at once.
CHUNK = 512
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def normal(line: str) -> str:
    """A line as it is compared: lower case, white space runs as one space, none at its ends."""
    line = line.lower()
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":  # the space is the only printable white space
        return line
    return " ".join(line.split())


def shingles(line: str, n: int = SHINGLE) -> set[str]:
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def packed(line: str) -> np.ndarray | None:
    """The distinct shingles of a line, each of its code points a byte of one integer; None if any takes more than a byte."""
    try:
        x = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    x = np.sort(np.ndarray((max(0, len(x) - SHINGLE + 1),), "<u8", x, 0, (1,)))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more."""
    small, large = sorted((len(x), len(y)))
    if not small or small < similarity * large:
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return bool(common >= similarity * (small + large - common))


def bands(lines: list[str], hashes: np.ndarray) -> np.ndarray:
    """Keys (line, band) of one-permutation MinHash signatures: each shingle's hash falls in one bin, whose least is kept.

    Empty bins take the next full bin's value, marked by the distance. A shingle is hashed from its code points, added up
    a byte apart, which are the bytes of the line where each is one.
    """
    bins = BANDS * ROWS
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    sig = np.full((len(lines), bins), np.iinfo(np.uint64).max, np.uint64)
    text, n = "".join(lines), int(lengths.sum()) - SHINGLE + 1
    if n > 0:
        try:
            x = np.ndarray((n,), "<u8", text.encode("latin-1"), 0, (1,))
        except UnicodeEncodeError:
            x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for k in (1, 2, 4):
                x = x[:-k] + (x[k:] << np.uint64(8 * k))
        h = _scatter(x)
        ends = np.cumsum(lengths)
        across = ends[:, None] - np.minimum(np.arange(1, SHINGLE), lengths[:, None])
        h[across[across < n]] = np.iinfo(np.uint64).max
        place = np.repeat(np.arange(len(lines)) * bins, lengths)[:n] + ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).view(np.int64)
        np.minimum.at(sig.reshape(-1), place, h)
    short = np.flatnonzero(lengths < SHINGLE)
    sig[short, 0] = _scatter(hashes[short])
    empty = np.iinfo(np.uint64).max
    gaps = np.flatnonzero((sig == empty).any(1))
    if len(gaps):
        s = sig[gaps]
        full = s != empty
        filled = s.copy()
        for far in range(1, bins):
            take = (filled == empty) & np.roll(full, -far, axis=1)
            filled[take] = np.roll(s, -far, axis=1)[take] + np.uint64(far * int(A) % (1 << 64))
        sig[gaps] = filled
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(ROWS):
        keys = _scatter(keys * A + sig[:, k::ROWS][:, :BANDS])
    return _scatter(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * B).view(np.int64)


def _lines(text: str | None) -> list[tuple[int, str]]:
    return [(k, s) for k, line in enumerate((text or "").split("\n")) if (s := normal(line))]


def occurrences(rows: DataFrame) -> DataFrame:
    """rows(_row, doc_id, text) to (_row, doc_id, line_no, h): every line with something in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, h = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for k, line in _lines(text):
                    at.append(i)
                    no.append(k)
                    h.append(line_hash(line))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["_row"].take(take), batch["doc_id"].take(take), pa.array(no, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["_row", "doc_id", "line_no", "h"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("_row", "doc_id", "text").mapInArrow(run, f"_row long, doc_id {kind}, line_no int, h long")


def bucket_pairs(keys: np.ndarray, ids: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b, large): pairs of runs of equal keys (sorted), all in small runs, a star and a chain in large ones.

    A run is large if it has more than SMALL rows or one that stands for others (thin).
    """
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    some_thin = np.maximum.reduceat(thin, first) if len(first) else np.zeros(0, bool)
    size, begin, large = np.repeat(sizes, sizes), np.repeat(first, sizes), np.repeat((sizes > SMALL) | some_thin, sizes)
    rows = np.arange(len(keys))
    at, a, b = [], [], []
    for d in range(1, SMALL):
        some = rows[~large & (size > d)]
        some = some[some + d < begin[some] + size[some]]
        at.append(some)
        a.append(ids[some])
        b.append(ids[some + d])
    rest = rows[large & (rows > begin)]
    at += [rest, rest]
    a += [ids[begin[rest]], ids[rest - 1]]
    b += [ids[rest], ids[rest]]
    of = np.concatenate(at)
    return keys[of], np.concatenate(a), np.concatenate(b), large[of]


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (k, a, b) of line hashes that share a bucket; k is the bucket if it is large, so that its lines can be told, else null.

    A task first thins out its own large buckets: one line is posted for them, the others are paired with it here. So a
    bucket that a third of all lines share sends one line a task through the shuffle.
    """

    # rows (k, a, b): a line of a bucket, b being 0, or a if it stands for others; or a pair of a large bucket
    def posted(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        ids, place = np.unique(ids, return_index=True)
        k, i = keys[place].T.ravel(), np.tile(ids, BANDS)
        order = np.argsort(k, kind="stable")
        k, i = k[order], i[order]
        head = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(head), len(k)))
        large = np.repeat(size, size) > SMALL
        bucket, a, b, _ = bucket_pairs(k[large], i[large], np.zeros(large.sum(), bool))
        own = ~large | head
        rows = np.concatenate((k[own], bucket)), np.concatenate((i[own], a)), np.concatenate((np.where(large[own], i[own], 0), b))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["k", "a", "b"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, n = [], [], 0
        seen = np.zeros(0, np.int64)
        for batch in batches:
            lines = {line_hash(line): line for text in batch["text"].to_pylist() for _, line in _lines(text)}
            if not lines:
                continue
            h = np.fromiter(lines, np.uint64, len(lines))
            new = ~np.isin(h.view(np.int64), seen)
            text = [line for line, x in zip(lines.values(), new.tolist(), strict=True) if x]
            h = h[new]
            if len(h):
                for at in range(0, len(h), CHUNK):
                    keys.append(bands(text[at : at + CHUNK], h[at : at + CHUNK]))
                ids.append(h.view(np.int64))
                seen = np.concatenate((seen, h.view(np.int64)))
                n += len(h)
            if n >= FLUSH:
                yield posted(np.concatenate(ids), np.concatenate(keys))
                ids, keys, n, seen = [], [], 0, np.zeros(0, np.int64)
        if ids:
            yield posted(np.concatenate(ids), np.concatenate(keys))

    def paired(k: np.ndarray, ids: np.ndarray, stands: np.ndarray) -> pa.RecordBatch:
        bucket, a, b, large = bucket_pairs(k, ids, stands != 0)
        return pa.RecordBatch.from_arrays([pa.array(bucket, mask=~large), pa.array(a), pa.array(b)], names=["k", "a", "b"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            k, a, b = rows = np.stack([batch[c].to_numpy() for c in ("k", "a", "b")])
            done = (b != 0) & (b != a)
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (k, a, b)], names=["k", "a", "b"])
            held = np.concatenate((held, rows[:, ~done]), axis=1)
            if held.shape[1] > FLUSH and held[0, 0] != held[0, -1]:
                at = np.searchsorted(held[0], held[0, -1])
                yield paired(*held[:, :at])
                held = held[:, at:]
        yield paired(*held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = rows.select("text").mapInArrow(post, "k long, a long, b long")
    dealt = F.when((F.col("b") != 0) & (F.col("b") != F.col("a")), F.xxhash64("a", "b")).otherwise(F.col("k"))  # a bucket's pairs are many
    pairs = posts.repartition(n, dealt).sortWithinPartitions("k", "a").mapInArrow(pair, "k long, a long, b long")
    return pairs.where("a <> b").select("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def token_array(line: str) -> np.ndarray:
    """The distinct shingles of a line as sorted integers, by the same rule for every line; none if it is shorter than one."""
    x = packed(line)
    if x is None:
        x = np.sort(np.fromiter({int(packed(s)[0]) if packed(s) is not None else line_hash(s) for s in shingles(line) if len(s) == SHINGLE}, np.uint64))
    return x


def parity(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """A bitmap of each set, as rows of 64-bit words: each member flips one bit. bits is a power of two.

    Two bitmaps differ in no more bits than the sets have members that only one of them has.
    """
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for at in range(0, len(sets), CHUNK):
        some = sets[at : at + CHUNK]
        bit = (_scatter(np.concatenate(some)) >> np.uint64(64 - bits.bit_length() + 1)).view(np.int64)
        flips = np.bincount(np.repeat(np.arange(len(some)) * bits, [len(x) for x in some]) + bit, minlength=len(some) * bits) & 1
        out[at : at + CHUNK] = np.packbits(flips.astype(np.uint8)).reshape(len(some), -1).view(np.uint64)
    return out


class Classes:
    """Union-find over class ids that a task meets, and the forest of what it has joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.forest.append((a, b))


def link_cell(lines: list[str], classes: np.ndarray, asks: np.ndarray, answers: np.ndarray, joined: Classes, similarity: float = SIMILARITY) -> None:
    """Join the classes of lines that have this Jaccard similarity or more, each asking line held against each answering one.

    Lines whose classes are joined are passed over, bitmaps rule out most of the others without a loss, and the rest are
    compared shingle by shingle.
    """
    sets = [token_array(x) for x in lines]
    sizes = np.array([len(x) for x in sets], np.int64)
    bits = parity(sets)
    names, place = np.unique(classes, return_inverse=True)
    label = np.array([joined.root(c) for c in names.tolist()], np.int64)[place]
    xs, ys = (np.flatnonzero(x & (sizes > 0)) for x in (asks, answers))
    slack, at_once = (1 - similarity) / (1 + similarity), max(1, HELD // max(1, len(ys)))
    for at in range(0, len(xs), at_once):
        some = xs[at : at + at_once]
        most = slack * (sizes[some][:, None] + sizes[ys]) + 1e-6
        near = label[some][:, None] != label[ys]
        near &= np.abs(sizes[some][:, None] - sizes[ys]) <= most
        apart = np.zeros(near.shape, np.uint16)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[some, w][:, None] ^ bits[ys, w])
        near &= apart <= most
        for i in np.flatnonzero(near.any(1)).tolist():
            x, to = some[i], ys[near[i]]
            to = to[np.argsort(apart[i, near[i]], kind="stable")]  # the likeliest first
            for part in (to[:1], to[1:]):
                part = part[label[part] != label[x]]
                if not len(part):
                    continue
                flat, own = np.concatenate([sets[y] for y in part.tolist()]), sets[x]
                hit = own[np.searchsorted(own, flat).clip(max=len(own) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                for y in part[common >= similarity * (sizes[part] + sizes[x] - common)].tolist():
                    if label[y] != label[x]:
                        joined.join(int(label[x]), int(label[y]))
                        low, high = sorted((label[x], label[y]))
                        label[label == high] = low


def open_posts(raw: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, i, j, ask, answer, class, line): the lines of large buckets that are still of several components, dealt to cells.

    In a bucket, the lines outside of its main class ask and all answer. Both are split into blocks of BLOCK lines by hash,
    and a cell (i, j) holds a block of either, so a bucket of any size is many bounded cells.
    """
    within = raw.where("k is not null").select("k", F.explode(F.array("a", "b")).alias("h")).distinct()
    within = cut(within.join(classes.withColumnRenamed("node", "h"), "h", "left").select("k", "h", F.coalesce("root", "h").alias("class")), "buckets")
    by_class = within.groupBy("k", "class").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_class.groupBy("k").agg(F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    asking, answering = (F.ceil(x / BLOCK).cast("int") for x in (F.col("n") - F.col("main.c"), F.col("n")))
    posts = within.join(mixed.select("k", F.col("main.class").alias("main"), asking.alias("ni"), answering.alias("nj")), "k")
    i, j, asks = F.pmod(F.xxhash64("h"), "ni").cast("int"), F.pmod(F.xxhash64("h"), "nj").cast("int"), F.col("class") != F.col("main")
    rows = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda x: F.struct(x.alias("i"), F.col("own_j").alias("j")))
    columns = F.when(asks, F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda x: F.struct(F.col("own_i").alias("i"), x.alias("j")))).otherwise(F.array())
    posts = posts.withColumns({"own_i": i, "own_j": j}).withColumn("cell", F.explode(F.array_distinct(F.concat(rows, columns))))
    ask, answer = asks & (F.col("cell.i") == F.col("own_i")), F.col("cell.j") == F.col("own_j")
    return posts.join(texts, "h").select("k", "cell.i", "cell.j", ask.alias("ask"), answer.alias("answer"), "class", "line")


def open_links(posts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """open_posts() to pairs (a, b) of classes that some lines of a bucket connect. A task returns a forest, so few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, held, last = Classes(), [], None

        def finish() -> None:
            rows = pa.Table.from_batches(held)
            link_cell(rows["line"].to_pylist(), *(rows[c].to_numpy() for c in ("class", "ask", "answer")), joined, similarity)
            held.clear()

        for batch in batches:
            cell = np.stack([batch[c].to_numpy() for c in ("k", "i", "j")])
            heads = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(0)))) if batch.num_rows else np.zeros(0, np.int64)
            for at, end in zip(heads.tolist(), [*heads.tolist()[1:], batch.num_rows], strict=False):
                now = tuple(cell[:, at].tolist())
                if held and now != last:
                    finish()
                last = now
                held.append(batch.slice(at, end - at))
        if held:
            finish()
        ends = list(zip(*joined.forest, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posts.repartition(n, "k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a long, b long")


def line_classes(raw: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, class) of the lines that are linked: components of the verified pairs, large buckets included whole.

    Stars and chains join most of a large bucket; buckets that they leave in several components are searched in cells.
    """
    pairs = cut(raw.select("a", "b").distinct(), "pairs")
    linked = cut(verify(pairs, texts), "linked")
    drop(pairs)
    classes = components(linked)
    known = classes.select(F.col("node").alias("h"), F.col("root").alias("class"))
    more = cut(open_links(open_posts(raw, classes, texts)), "more")
    if more.isEmpty():
        return known
    merged = components(more)
    every = known.unionByName(more.select(F.explode(F.array("a", "b")).alias("h")).select("h", F.col("h").alias("class"))).distinct()
    return every.join(merged.withColumnRenamed("node", "class"), "class", "left").select("h", F.coalesce("root", "class").alias("class"))


def line_texts(rows: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line): the normal form of each wanted line, read from the document in which it stands first."""
    spots = found.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("_row", "line_no")).alias("at"))
    by_row = spots.groupBy(F.col("at._row").alias("_row")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "h")).alias("need"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = [], []
            for text, need in zip(batch["text"].to_pylist(), batch["need"].to_pylist(), strict=True):
                lines = text.split("\n")
                for x in need:
                    h.append(x["h"])
                    out.append(normal(lines[x["line_no"]]))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], names=["h", "line"])

    return rows.select("_row", "text").join(by_row, "_row").select("text", "need").mapInArrow(run, "h long, line string")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray | None] = OrderedDict()

        def bytewise(h: int, line: str) -> np.ndarray | None:
            if h not in kept:
                kept[h] = packed(line)
                if len(kept) > 512:
                    kept.popitem(last=False)
            return kept[h]

        def good(a: int, b: int, s: str, t: str) -> bool:
            x, y = bytewise(a, s), bytewise(b, t)
            if x is not None and y is not None:
                return similar(x, y, similarity)
            v, w = shingles(s), shingles(t)
            return len(v & w) >= similarity * len(v | w)

        for batch in batches:
            stay = pa.array([good(*x) for x in zip(*(batch[c].to_pylist() for c in ("a", "b", "s", "t")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(stay), batch["b"].filter(stay)], names=["a", "b"])

    x, y = (texts.select(F.col("h").alias(k), F.col("line").alias(v)) for k, v in (("a", "s"), ("b", "t")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def without_lines(docs: DataFrame) -> DataFrame:
    """docs with text_lines, text_dropped (counts) beside the text without its repeated lines, which is in place of the text.

    The names of docs are plain ones of sheltered(), so that none clashes.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = cut(occurrences(rows), "lines")
    raw = cut(candidate_pairs(rows), "pairs")
    texts = cut(line_texts(rows, found, raw.select(F.col("a").alias("h")).unionAll(raw.select("b")).distinct()), "texts")
    classes = cut(line_classes(raw, texts), "classes")
    drop(raw, texts)
    named = found.join(classes, "h", "left").select("_row", "line_no", F.coalesce("class", "h").alias("class"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "line_no").alias("at"))
    named = cut(named, "named")
    firsts = named.groupBy("class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first")
    gone = named.join(firsts, "class").where("at <> first").groupBy("_row").agg(F.collect_list("line_no").alias("_gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, dropped = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["_gone"].to_pylist(), strict=True):
                if text is None:
                    out.append(None)
                    counts.append(0)
                    dropped.append(0)
                    continue
                lines, away = text.split("\n"), set(gone or ())
                out.append("\n".join(x for k, x in enumerate(lines) if k not in away) if away else text)
                counts.append(len(lines))
                dropped.append(len(away))
            rest = [c for c in batch.schema.names if c not in ("text", "_gone")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], names=[*rest, "text_lines", "text_dropped", "text"])

    joined = rows.join(gone, "_row", "left").drop("_row")
    schema = docs.drop("text").select("*", F.lit(None).cast("long").alias("text_lines"), F.lit(None).cast("long").alias("text_dropped"), F.lit(None).cast("string").alias("text")).schema
    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with line_count, dropped (count) and the text without its repeated lines.

    Lines are compared in their normal form. Equal lines, and lines linked by verified pairs, form components, of which
    the line that stands first stays: by doc_id, null last, then by row and place. Blank lines are not compared and stay.
    A null text stays null; a text all of whose lines stand elsewhere becomes empty; an empty table stays empty; columns
    of docs that have the names of the counts give way to them, others pass through. docs must be a table scan, as rows
    are numbered. Recall: all equal lines; pairs at the similarity share a bucket with probability 0.997, more above it;
    no pair that shares a bucket is lost, however large the bucket. Lines are told apart by 64 bits.
    """
    counts = {"line_count": "text_lines", "dropped": "text_dropped"}
    kept = docs.drop(*counts)
    plain, names = sheltered(kept, "doc_id", "text")
    out = without_lines(plain)
    return out.select(*(F.col(names[c]).alias(c) for c in kept.columns if c != "text"), *(F.col(v).alias(k) for k, v in counts.items()), "text")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it or an earlier one has, or nearly has."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their lines deduplicated, and n_chars counted anew. A text that lost all its lines is empty."""
    plain, names = sheltered(docs, "doc_id", "text")
    out = without_lines(plain)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(names[c]).alias(c) for c in docs.columns))
