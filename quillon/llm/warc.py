"""WARC archives: write request, response, revisit and metadata records, read them back, and assemble transactions.

Archives are gzip files that Spark's text sink writes: a row holds the records of one capture and the line separator is
the blank lines that end a record. They go through Spark's file systems only, so they may lie in any store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, shared_path, table

END = "\r\n"
#: Records with smaller payloads never become revisits.
LEAST_REVISIT = 100
#: Bytes of payloads of an archive, about: it is unpacked whole by whoever reads it.
MOST_BYTES = 1 << 29
RECORDS = "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to string, refers_to string, header_digest string, http_length long, block_bytes long, payload_bytes long, payload_digest string, fields string, payload binary"


def _uuid(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("null")) for c in of)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, block: Column, content: str, *more: tuple[str, Column]) -> Column:
    """Header lines of null values are left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}")]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    head += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *head), F.lit(END + END), block)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds row_no, payload_bytes, payload_digest and, for revisits, first(page_id, row_no) of the response they repeat.

    pages must be a table scan, as row_no numbers its rows. Equal payloads of LEAST_REVISIT bytes or more have one response:
    that of the smallest page_id, null last, then of the first row. The groups are combined before the shuffle; the rows
    of a common payload are joined to one row of its group, which adaptive execution splits.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row_no"), "page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload.cast("binary"), 256)})
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_no")
    groups = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("payload_digest", "first")
    joined = rows.join(groups, "payload_digest", "left")
    return joined.withColumn("first", F.when(F.col("first.row_no") != F.col("row_no"), F.struct("first.page_id", "first.row_no")))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 5000, most_bytes: int = MOST_BYTES) -> None:
    """Write three records a page - request, response or revisit, metadata - to gzip WARC files of per_file pages at most.

    Pages are written by classes of size, each four times the one before, so that no file holds more than about most_bytes
    of payloads, or a single page; a class that has no page makes no pass.

    pages(page_id, url, html): a null html is an empty payload, a null url leaves out the target, a null page_id leaves
    out its metadata field; equal rows become captures of their own. Line ends within a url are percent-encoded. Other
    columns are ignored. An empty table makes no file.
    """
    rows = with_revisits(pages)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    again, target = F.col("first").isNotNull(), ("WARC-Target-URI", url)
    ids = {kind: _uuid(kind, F.col("row_no"), F.col("page_id")) for kind in ("request", "capture", "metadata")}
    first = F.when(again, _uuid("capture", F.col("first.row_no"), F.col("first.page_id")))
    place = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END), F.when(again, F.lit("")).otherwise(F.coalesce("html", F.lit(""))))
    notes = F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit("via: crawl"))
    near = ("WARC-Concurrent-To", ids["capture"])
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest"))
    profile = ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    records = [
        _record(F.lit("request"), ids["request"], date, ask, "application/http;msgtype=request", target, near),
        _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), ids["capture"], date, answer, "application/http;msgtype=response", target, digest, profile, ("WARC-Refers-To", first)),
        _record(F.lit("metadata"), ids["metadata"], date, notes, "application/warc-fields", target, near),
    ]
    large = max(1, most_bytes // per_file)
    size = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col("payload_bytes"), F.lit(1)) / large))).cast("int")
    length = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.octet_length("html"), F.lit(1)) / large))).cast("int")
    classes = [r["size"] for r in pages.select(F.coalesce(length, F.lit(0)).alias("size")).distinct().collect()]  # 32 at most
    for k in sorted(classes) or [0]:
        own = rows.where(size == k) if len(classes) > 1 else rows
        own.select(F.concat_ws(END + END, *records).alias("value")).write.mode("append").options(lineSep=END + END, compression="gzip", maxRecordsPerFile=max(1, per_file // 4**k)).text(path)


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return found


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the records' own lengths; gzip of one or more members, or plain."""
    while data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            plain.append(unzip.decompress(rest) + unzip.flush())
            rest = unzip.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _fields(data[at:end])
        n = int(fields.get("content-length", "0"))
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder. Without payloads that column is null, but sizes and digests are there.

    payload_bytes and payload_digest are those of the payload in the record; header_digest and http_length are what its
    headers state, which for a revisit describe the payload it does not repeat. fields: the block of a metadata record.
    """

    def records(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for f, block in parse(data):
                    kind = f.get("warc-type", "")
                    head, payload = b"", block
                    if f.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    length = _fields(head).get("content-length")
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-payload-digest"), int(length) if length else None, len(block), len(payload), hashlib.sha256(payload).hexdigest(), block.decode("utf-8", "replace") if kind == "metadata" else None, payload if payloads else None))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                out["http_length"] = out["http_length"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(records, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the request and metadata concurrent to it, or null.

    A capture without a request or metadata keeps a null there. Of several records concurrent to one capture each makes a
    row. Records that name no known capture are dropped, as are captures without a record id.
    """
    kinds = {
        "request": ["record_id", "target_uri", "warc_date", "block_bytes", "payload"],
        "metadata": ["record_id", "warc_date", "fields"],
        "response": ["record_id", "warc_type", "target_uri", "warc_date", "refers_to", "header_digest", "http_length", "payload_bytes", "payload_digest", "payload"],
    }
    main = records.where("warc_type in ('response', 'revisit') and record_id is not null").select(F.col("record_id").alias("capture_id"), F.struct(*kinds["response"]).alias("response"))
    for kind in ("request", "metadata"):
        side = records.where(F.col("warc_type") == kind).where("concurrent_to is not null").select(F.col("concurrent_to").alias("capture_id"), F.struct(*kinds[kind]).alias(kind))
        main = main.join(side, "capture_id", "left")
    return main.select("capture_id", "request", "response", "metadata")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives of all pages to the shared folder, read them back, and tell what each capture holds."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = cut(read_archives(spark, path, payloads=False).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records")
    page = F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?\d+)\r?$", 1)
    captures = assemble(records).select(
        "capture_id",
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.when(F.col("response.warc_type") == "revisit", F.col("response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(F.col("response.warc_type") == "revisit", F.substring_index("response.header_digest", ":", -1)).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to").alias("refers"),
        F.col("response.target_uri").alias("url"),
    )
    captures = cut(captures, "captures")
    firsts = captures.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    again = captures.where("refers is not null").join(firsts, "refers", "left").select(*columns)
    return captures.where("refers is null").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again)


OP1_SQL = """
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_page from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to, url
from f
"""
