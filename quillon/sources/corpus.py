"""Corpora: files read from folders, adapters for tables, and the tables of an index.

schema: corpus(rel_path, text, size_bytes, modified_unix_secs, encoding).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import globs, grams
from quillon.sources import store

SCHEMA_VERSION = 2
#: Bytes of a row group of postings: small, so that a look-up reads little.
ROW_GROUP = 1 << 20
MOST_BYTES = 1 << 20
#: Grams that a task counts before it hands them on, and documents that it holds at once meanwhile.
MOST_COUNTS, SLICE = 1 << 18, 256
SNIFFED = 4096
#: Extensions of files that hold no text.
BINARY = "7z a bin bmp class dll dylib eot exe gif gz ico jar jpeg jpg lib mov mp3 mp4 o obj otf pdf png pyc so tar tif tiff ttf wasm wav webp woff woff2 zip".split()
INDEX_FOLDERS = r"(^|/)(\.git|\.index)/"
CORPUS = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("modified_unix_secs", T.LongType()), T.StructField("encoding", T.StringType())])
CHANGES = "kind string, rel_path string, new_rel_path string, generation long"
USAGES = "record string, symbol_id string, name string, raw_text string, uri string, rel_path string, start_line int, start_column int, end_line int, end_column int, enclosing_symbol_id string, edge_kind string"


def _bom(c: Column, mark: str) -> Column:
    return F.substring(c, 1, len(mark) // 2) == F.unhex(F.lit(mark))


def encoding(content: Column) -> Column:
    return F.when(_bom(content, "EFBBBF"), "utf-8-bom").when(_bom(content, "FFFE"), "utf-16le").when(_bom(content, "FEFF"), "utf-16be").otherwise("utf-8")


def decode(content: Column) -> Column:
    """By byte order mark, which is dropped; else UTF-8 with replacement of what is not."""
    cut = lambda n: F.substring(content, F.lit(n), F.octet_length(content))
    utf8 = lambda c: F.make_valid_utf8(c.cast("string"))
    kind = encoding(content)
    return F.when(kind == "utf-8-bom", utf8(cut(4))).when(kind == "utf-16le", F.decode(cut(3), "UTF-16LE")).when(kind == "utf-16be", F.decode(cut(3), "UTF-16BE")).otherwise(utf8(content))


def is_binary(content: Column) -> Column:
    """A zero byte near the start, without the mark of a 16-bit encoding."""
    return ~_bom(content, "FFFE") & ~_bom(content, "FEFF") & F.hex(F.substring(content, 1, SNIFFED)).rlike("^(..)*?00")


def classify(files: DataFrame, root: str, scope: globs.Scope | None = None, most: int = MOST_BYTES) -> DataFrame:
    """binaryFile rows with rel_path and fate: index_folder, binary_extension, too_large, binary or text."""
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rel = F.expr("substring(_p, length(_r) + 1)")
    rows = files.withColumn("_p", path).withColumn("_r", F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")).withColumn("rel_path", rel)
    if scope:
        rows = rows.where(scope.filter(F.col("rel_path")))
    ext = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1))
    fate = F.when(F.col("rel_path").rlike(INDEX_FOLDERS), "index_folder").when(ext.isin(*BINARY), "binary_extension").when(F.col("length") > most, "too_large").when(is_binary(F.col("content")), "binary").otherwise("text")
    return rows.withColumn("fate", fate).drop("_p", "_r")


def scan(spark: SparkSession, root: str, scope: globs.Scope | None = None, most: int = MOST_BYTES) -> DataFrame:
    """The text files under a folder. Size is filtered by the source, so larger files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
    rows = classify(files, root, scope, most).where("fate = 'text'")
    return rows.select("rel_path", decode(F.col("content")).alias("text"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_unix_secs"), encoding(F.col("content")).alias("encoding"))


def scan_stats(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """One row: files seen, indexed, and left out by reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = classify(files, root, most=most)
    n = lambda c: F.count_if(c).alias
    fate = F.col("fate")
    return rows.agg(F.count(F.lit(1)).alias("visited"), n(fate == "text")("indexed"), n(fate == "binary")("skipped_binary"), n(fate == "binary_extension")("skipped_binary_extension"), n(fate == "too_large")("skipped_too_large"), n((fate == "text") & encoding(F.col("content")).startswith("utf-16"))("decoded_utf16"))


def count_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").agg(F.count(F.lit(1)).alias("files"))


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id"), path.alias("rel_path"), "text", F.octet_length("text").cast("long").alias("size_bytes"))


def of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return p.select(F.col("page_id").alias("doc_id"), path.alias("rel_path"), F.col("html").alias("text"), F.octet_length("html").cast("long").alias("size_bytes"))


def _each(batch: pa.RecordBatch, cutter: grams.Cutter) -> Iterator[tuple[int, dict[str, None], bool]]:
    for at, (path, text) in enumerate(zip(batch["_path"].to_pylist(), batch["_text"].to_pylist(), strict=True)):
        yield at, *cutter.document(path, text)


def _tokenised(corpus: DataFrame, *columns: str) -> DataFrame:
    return corpus.select("doc_id", *columns, grams.raw_tokens(F.col("rel_path")).alias("_path"), grams.raw_tokens(F.col("text")).alias("_text"))


def index_rows(corpus: DataFrame) -> DataFrame:
    """Two kinds of rows in one pass over the texts.

    Without a gram: doc_id, rel_path, byte_len, content hash, the count of grams up to the limit, and whether the limit cut
    them. With one: docs, a list of n documents that hold it; a row a gram and batch, so no list outgrows a batch.
    """
    own = ["doc_id", "rel_path", "byte_len", "content_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = grams.Cutter()
        for batch in batches:
            lists: dict[str, list[int]] = {}
            counts, cuts = [], []
            for at, (path, text) in enumerate(zip(batch["_path"].to_pylist(), batch["_text"].to_pylist(), strict=True)):
                found, cut = cutter.document(path, text)
                counts.append(len(found))
                cuts.append(cut)
                for g in found:
                    lists.setdefault(g, []).append(at)
            sizes = [len(x) for x in lists.values()]
            flat = pa.array(list(chain.from_iterable(lists.values())), pa.int32())
            docs = pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), batch["doc_id"].take(flat))
            posted = pa.table({"gram": pa.array(list(lists), pa.string()), "docs": docs, "n": pa.array(sizes, pa.int64())})
            told = pa.table({**{x: batch[x] for x in own}, "gram_count": pa.array(counts, pa.int64()), "gram_incomplete": pa.array(cuts, pa.bool_())})
            schema = pa.unify_schemas([told.schema, posted.schema])
            for part in (told, posted):
                filled = [part[f.name] if f.name in part.column_names else pa.nulls(part.num_rows, f.type) for f in schema]
                yield from pa.table(filled, schema=schema).to_batches()

    kind = corpus.schema["doc_id"].dataType.simpleString()
    rows = corpus.select("doc_id", "rel_path", F.col("size_bytes").cast("long").alias("byte_len"), F.xxhash64("text").alias("content_hash"), grams.raw_tokens(F.col("rel_path")).alias("_path"), grams.raw_tokens(F.col("text")).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, rel_path string, byte_len long, content_hash long, gram_count long, gram_incomplete boolean, gram string, docs array<{kind}>, n long")


def typed_gram_df(corpus: DataFrame) -> DataFrame:
    """(kind, gram, df): in how many documents a gram of each of `grams.KINDS` stands.

    One Arrow pass cuts tokens that a task has not seen, counts documents by gram, and hands the counts on whenever they
    are MOST_COUNTS, so that a shuffle has a row a gram and task instead of one a gram and document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = grams.Cutter(), tuple(Counter() for _ in grams.KINDS)

        def told() -> Iterator[pa.RecordBatch]:
            for kind, count in zip(grams.KINDS, counts, strict=True):
                if count:
                    yield pa.RecordBatch.from_arrays([pa.repeat(kind, len(count)), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["kind", "gram", "df"])
                count.clear()

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for path, text in zip(batch["_path"].to_pylist(), batch["_text"].to_pylist(), strict=True):
                for count, found in zip(counts, grams.typed(cutter, path, text), strict=True):
                    count.update(found)
            if sum(map(len, counts)) >= MOST_COUNTS:
                yield from told()
        yield from told()

    once = corpus.select(F.array_distinct(grams.raw_tokens(F.col("rel_path"))).alias("_path"), F.array_distinct(grams.raw_tokens(F.col("text"))).alias("_text"))
    return once.mapInArrow(run, "kind string, gram string, df long").groupBy("kind", "gram").agg(F.sum("df").alias("df"))


def index_docs(rows: DataFrame) -> DataFrame:
    return rows.where("gram is null").drop("gram", "docs", "n")


def posting_blocks(rows: DataFrame) -> DataFrame:
    return rows.where("gram is not null").select("gram", "docs", "n")


def postings(blocks: DataFrame) -> DataFrame:
    """(gram, doc_id), each once. A condition on the gram reaches the scan of the blocks."""
    return blocks.select("gram", F.explode("docs").alias("doc_id"))


def write_index(corpus: DataFrame, path: str, parts: int | None = None, generation: int = 0) -> None:
    """docs in path order, posting blocks sorted by gram so that row groups and bloom filters prune, and a one-row manifest, which is written last.

    The rows are made once, into a folder that goes in the end: range partitioning reads them twice.
    """
    spark, staged = corpus.sparkSession, f"{path}/staged"
    index_rows(store.spread(corpus, "doc_id")).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    index_docs(rows).repartitionByRange("rel_path").sortWithinPartitions("rel_path").write.mode("overwrite").parquet(f"{path}/docs")
    by, blocks = ["gram", F.get("docs", F.lit(0))], posting_blocks(rows)
    blocks = blocks.repartitionByRange(parts, *by) if parts else blocks.repartitionByRange(*by)
    blocks.sortWithinPartitions(*by).write.mode("overwrite").option("parquet.bloom.filter.enabled#gram", "true").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/docs")
    written.agg(F.lit(SCHEMA_VERSION).alias("schema_version"), F.bit_xor(F.xxhash64("rel_path", "content_hash")).alias("fingerprint"), F.count(F.lit(1)).alias("docs"), F.sum("byte_len").alias("bytes"), F.lit(generation).cast("long").alias("generation")).write.mode("overwrite").parquet(f"{path}/manifest")
    store.remove(spark, staged)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, postings). Another schema version is an error, not a migration."""
    found = spark.read.parquet(f"{path}/manifest").first()
    if found["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"index has schema version {found['schema_version']}, not {SCHEMA_VERSION}")
    docs = spark.read.parquet(f"{path}/docs").withColumn("gram_incomplete", F.coalesce("gram_incomplete", F.lit(False)))
    return docs, postings(read_blocks(spark, path))


_written: dict[tuple[str, str, str], str] = {}


def index_of_documents(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index over the documents of a folder: written once a session, and again when the files change."""
    key = spark.sparkContext.applicationId, sf_dir, store.stamp(spark, f"{sf_dir}/documents.parquet")
    if key not in _written:
        path = store.new_path(spark, "index")
        write_index(of_documents(spark, sf_dir), path)
        _written[key] = path
    return _written[key]


def read_usages(spark: SparkSession, path: str) -> DataFrame:
    """References from tab-separated U rows with percent-encoded fields; the edge kind may be missing."""
    rows = spark.read.csv(path, sep="\t", schema=USAGES, quote="", mode="PERMISSIVE").where("record = 'U'").drop("record")
    text = ["symbol_id", "name", "raw_text", "uri", "rel_path", "enclosing_symbol_id"]
    rows = rows.withColumns({c: F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B"))) for c in text})
    return rows.withColumnRenamed("symbol_id", "target_symbol_id").withColumns({"edge_kind": F.coalesce("edge_kind", F.lit("usage")), "enclosing_symbol_id": F.when(F.col("enclosing_symbol_id") != "", F.col("enclosing_symbol_id"))})


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
