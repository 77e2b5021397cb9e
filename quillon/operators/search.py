"""Search: candidate pruning by grams, exact verification, positions, ranking, pages and counts.

Pruning is a semi-join that keeps a superset; verification alone decides.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.globs import depth, is_library
from quillon.plans.query import Request, any_pattern, pattern, plan
from quillon.sources.store import spread

SOH, STX = "\x01", "\x02"
PREVIEW = 240
#: Characters of previews that are sent at once.
FLUSH = 1 << 22
#: What a secret's name looks like, and files whose assignments are all secret.
SECRET = r"(?i)\b([\w.-]*(?:password|passwd|secret|token|credential|api[_-]?key|private[_-]?key)[\w.-]*\s*[:=]\s*)(\"[^\"\n]*\"|'[^'\n]*'|[\"'`]?[^\s\"'`]+)"
PEM = r"-----BEGIN [^-]+-----[\s\S]*?-----END [^-]+-----"
SENSITIVE = r"(?i)(^|/)(\.env(\.[^/]*)?|[^/]*credentials[^/]*|secrets\.[^/]*|id_[dr]sa|\.npmrc|\.pypirc|[^/]*\.(pem|key|p12|pfx))$|/\.config/gcloud/"


def scoped(corpus: DataFrame, r: Request) -> DataFrame:
    return corpus.where(r.scope.filter(F.col("rel_path")))


def matching_docs(postings: DataFrame, sets: list[frozenset[str]]) -> DataFrame:
    """doc_id of documents that have every gram of one of the sets: one scan of the postings for all grams, one count a set. Postings are distinct."""
    grams = sorted(set().union(*sets))
    found = postings.where(F.col("gram").isin(grams)).groupBy("doc_id").agg(*(F.count_if(F.col("gram").isin(sorted(s))).alias(f"n{k}") for k, s in enumerate(sets)))
    return found.where(reduce(lambda a, b: a | b, [F.col(f"n{k}") == len(s) for k, s in enumerate(sets)])).select("doc_id")


def candidates(docs: DataFrame, postings: DataFrame, r: Request) -> DataFrame:
    """doc_id of documents that may match: those of the plan, and all whose grams were cut. Postings are distinct."""
    docs = scoped(docs, r)
    sets = plan(r)
    if sets is None:
        return docs.select("doc_id")
    found = matching_docs(postings, sets)
    whole = docs.where(~F.col("gram_incomplete")).select("doc_id").join(found, "doc_id", "left_semi")
    return whole.unionAll(docs.where("gram_incomplete").select("doc_id"))


def pruned(corpus: DataFrame, docs: DataFrame, postings: DataFrame, r: Request) -> DataFrame:
    """The rows of the corpus that may match."""
    return corpus.join(candidates(docs, postings, r), "doc_id", "left_semi")


def trigram_candidates(corpus_trigrams: DataFrame, literal: str) -> DataFrame:
    """corpus_trigrams(doc_id, gram) to the documents that have all trigrams of the literal; all of them if it is shorter."""
    low = literal.lower()
    want = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not want:
        return corpus_trigrams.select("doc_id").distinct()
    return matching_docs(corpus_trigrams, [frozenset(want)])


def trigram_postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, gram): the distinct three-character windows of the whole lower-cased text, spaces and line ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [list({t[i : i + 3] for i in range(len(t) - 2)}) for t in part["text"].to_pylist()]
                take = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(take), pa.array([g for x in found for g in x], pa.string())], names=["doc_id", "gram"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    return spread(corpus, "doc_id").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"doc_id {kind}, gram string")


def contains_any(text: Column, r: Request) -> Column:
    """Whether some term is found: plain containment where that is the same, else the pattern."""
    if r.mode == "literal" and r.case_sensitive and not r.whole_word:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in r.terms])
    return text.rlike(any_pattern(r))


def _counter(pattern_: str):
    return lambda x: F.regexp_count(x, F.lit(pattern_))


def occurrence_counts(corpus: DataFrame, r: Request) -> DataFrame:
    """rel_path, size_bytes, matches: non-overlapping occurrences in files with any; those of several terms are merged, and the same place counts once. Line-wise for a single-line regex."""
    if len(r.terms) > 1:
        return match_positions(corpus, r).groupBy("rel_path", "size_bytes").agg(F.count(F.lit(1)).alias("matches"))
    rows = scoped(corpus, r).where(contains_any(F.col("text"), r))
    own = pattern(r, r.terms[0])
    if r.mode == "regex" and not r.multiline:
        lines = F.split(F.regexp_replace("text", "\r(?=\n)|\r$", ""), "\n")
        n = F.aggregate(F.transform(lines, _counter(own)), F.lit(0), lambda a, x: a + x)
    else:
        n = F.regexp_count("text", F.lit(own))
    return rows.select("rel_path", "size_bytes", n.cast("long").alias("matches")).where("matches > 0")


def _place_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked texts to the places of their matches, in one pass over each: lines are found by the ends of lines."""
    names = ["rel_path", "size_bytes", "line", "start_column", "end_line", "end_column", "preview"]
    for batch in batches:
        of, cols = [], [[] for _ in names[2:]]
        size = 0
        for i, (base, marked) in enumerate(zip(batch["line0"].to_pylist(), batch["marked"].to_pylist(), strict=True)):
            parts = marked.split(SOH)
            text = "".join(parts).replace(STX, "")
            ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
            at = len(parts[0])
            for part in parts[1:]:
                n = part.index(STX)
                first, last = bisect_left(ends, at), bisect_left(ends, at + n)
                begin = ends[first - 1] + 1 if first else 0
                end = at + n - (ends[last - 1] + 1 if last else 0)
                stop = max(ends[first], at + n) if first == last else ends[first]
                row = base + first, at - begin, base + last if last > first else None, end, clipped(text, begin, stop, at, at + n)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
                of.append(i)
                at += len(part) - 1
                size += len(row[-1])
                if size >= FLUSH:
                    yield _matches(batch, of, cols, names)
                    of, cols, size = [], [[] for _ in names[2:]], 0
        yield _matches(batch, of, cols, names)


def _matches(batch: pa.RecordBatch, of: list[int], cols: list[list], names: list[str]) -> pa.RecordBatch:
    take = pa.array(of, pa.int64())
    kinds = [pa.int32()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([batch["rel_path"].take(take), batch["size_bytes"].take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def clipped(text: str, begin: int, stop: int, at: int, end: int) -> str:
    """The line that a match begins in; of a long one, PREVIEW characters round the match, with marks where it is cut."""
    stop -= text[stop - 1 : stop] == "\r" and stop - 1 >= begin
    if stop - begin <= PREVIEW:
        return text[begin:stop]
    a = max(begin, at - max(0, (PREVIEW - (min(end, stop) - at)) // 2))
    b = min(stop, a + PREVIEW)
    return ("\u2026" if a > begin else "") + text[a:b] + ("\u2026" if b < stop else "")


def match_positions(corpus: DataFrame, r: Request) -> DataFrame:
    """rel_path, size_bytes, line, start_column, end_line, end_column, preview: every match of every term, each once.

    Lines and columns count code points from 0; end_line is null within one line. The JVM marks the matches by two
    characters that the text is first stripped of; one pass over the marked text gives the places, so the work grows with
    the text and its matches alone.
    """
    rows = scoped(corpus, r).where(contains_any(F.col("text"), r))
    clean = F.regexp_replace("text", f"[{SOH}{STX}]", "")
    found = None
    for t in r.terms:
        own = pattern(r, t)
        if r.mode == "regex" and not r.multiline:
            each = rows.select("rel_path", "size_bytes", F.posexplode(F.split(clean, "\n")).alias("line0", "body"))
            each = each.withColumn("body", F.regexp_replace("body", "\r$", ""))
        else:
            each = rows.select("rel_path", "size_bytes", F.lit(0).alias("line0"), clean.alias("body"))
        marked = each.where(F.col("body").rlike(own)).select("rel_path", F.col("size_bytes").cast("long").alias("size_bytes"), "line0", F.regexp_replace("body", own, SOH + "$0" + STX).alias("marked"))
        places = marked.mapInArrow(_place_matches, "rel_path string, size_bytes long, line int, start_column int, end_line int, end_column int, preview string")
        found = places if found is None else found.unionByName(places)
    return found if len(r.terms) == 1 else found.dropDuplicates(["rel_path", "line", "start_column", "end_line", "end_column"])


def score(matches: Column, path: Column) -> Column:
    return (100 * matches - 3 * depth(path) - F.octet_length(path)).cast("long")


def ranked(matches: DataFrame) -> DataFrame:
    """Matches with their file's score: score falling, then path."""
    per = Window.partitionBy("rel_path")
    return matches.withColumn("score", score(F.count(F.lit(1)).over(per), F.col("rel_path")))


def page(matches: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Matches offset .. offset + limit in the order of score, path and position: a stable order, so pages are its slices."""
    return in_order(ranked(matches)).offset(offset).limit(limit)


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), "rel_path", "line", "start_column", F.coalesce("end_line", "line"), "end_column")


def early_page(matches: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """As an engine that stops early would page: matches in path order until offset + limit + 1, ranked among themselves.

    A file that is listed has a match, so no more files than matches are wanted: the first by path are taken, and running
    sums over these drop what is beyond the target.
    """
    target = offset + max(limit, 1) + 1
    per = matches.groupBy("rel_path").count().orderBy("rel_path").limit(target)
    before = F.coalesce(F.sum("count").over(Window.orderBy("rel_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = per.withColumn("before", before).where(F.col("before") < target).select("rel_path", "before")
    place = F.row_number().over(Window.partitionBy("rel_path").orderBy("line", "start_column"))
    scanned = matches.join(kept, "rel_path").withColumn("_place", place).where("before + _place <= " + str(target))
    return page(scanned.drop("before", "_place"), limit, offset)


def count_by_file(counts: DataFrame) -> DataFrame:
    return counts.select("rel_path", "matches").orderBy(F.desc("matches"), "rel_path")


def bounded_count(counts: DataFrame, most: int) -> DataFrame:
    total = F.coalesce(F.sum("matches"), F.lit(0)).cast("long")
    return counts.agg(F.least(total, F.lit(most).cast("long")).alias("total"), (total <= most).alias("exact"))


def probe(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("files"))


def exists(corpus: DataFrame, r: Request) -> DataFrame:
    """One row, 1 or 0: a limit of one row stops the scan."""
    return scoped(corpus, r).where(contains_any(F.col("text"), r)).limit(1).agg(F.count(F.lit(1)).cast("int").alias("found"))


def explain(docs: DataFrame, postings: DataFrame, r: Request) -> DataFrame:
    """One row per required gram with its document frequency, and the count of candidates."""
    sets = plan(r) or []
    grams = sorted(set().union(*sets)) if sets else []
    spark = docs.sparkSession
    want = spark.createDataFrame([(g,) for g in grams], "gram string")
    df = postings.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("df")) if grams else spark.createDataFrame([], "gram string, df long")
    total = candidates(docs, postings, r).agg(F.count(F.lit(1)).alias("candidates"))
    return want.join(df, "gram", "left").crossJoin(F.broadcast(total)).select("gram", F.coalesce("df", F.lit(0)).cast("long").alias("df"), "candidates")


def redact(path: Column, text: Column) -> Column:
    """Key blocks, values of names that sound secret, and all assignments of sensitive files."""
    out = F.regexp_replace(F.regexp_replace(text, PEM, "[REDACTED]"), SECRET, "$1[REDACTED]")
    return F.when(path.rlike(SENSITIVE), F.regexp_replace(out, r"(?m)^(\s*[\w.-]+\s*[:=]\s*).+$", "$1[REDACTED]")).otherwise(out)


def nearest_rank(rows: DataFrame, by: str, value: str, share: float, ranges: int = 64) -> DataFrame:
    """(by, value): the value at the place ceil(share * (n - 1)) of each group, from 0. Nulls take no part.

    About equal ranges of the values are told by approximate quantiles, which only say where to look: the range that holds
    the place is found by exact counts, and it alone is put in order.
    """
    rows = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("value"))
    marks = rows.groupBy(by).agg(F.percentile_approx("value", F.array(*(F.lit(k / ranges) for k in range(1, ranges)))).alias("marks"))
    dealt = rows.groupBy(by, "value").agg(F.count(F.lit(1)).alias("n")).join(marks, by).withColumn("range", F.size(F.filter("marks", lambda m: m < F.col("value")))).drop("marks")
    sums = dealt.groupBy(by, "range").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(by).orderBy("range")
    place = F.ceil(F.lit(share) * (F.sum("n").over(Window.partitionBy(by)) - 1))
    sums = sums.select(by, "range", place.alias("place"), (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(order).alias("through"))
    inside = dealt.join(sums.where("before <= place and place < through"), [by, "range"])
    reach = F.col("before") + F.sum("n").over(Window.partitionBy(by).orderBy("value"))
    return inside.withColumn("reach", reach).where("place < reach").groupBy(by).agg(F.min("value").alias("value"))


def quality(pruned_: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row over rel_path sets: overlap, missing, extra, recall, precision of a search against a full scan."""
    a, b = (x.select("rel_path").distinct().withColumn(n, F.lit(1)) for x, n in ((pruned_, "a"), (scanned, "b")))
    n = lambda c: F.count_if(c)
    both, only_b, only_a = n(F.col("a").isNotNull() & F.col("b").isNotNull()), n(F.col("a").isNull()), n(F.col("b").isNull())
    share = lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(1.0)
    return a.join(b, "rel_path", "full").agg(both.alias("overlap"), only_b.alias("missing"), only_a.alias("extra"), share(both, only_b).alias("recall"), share(both, only_a).alias("precision"))


def merge_snippets(ranges: DataFrame) -> DataFrame:
    """ranges(rel_path, start_line, end_line) with overlapping or adjacent ones of a file merged: gaps and islands."""
    order = Window.partitionBy("rel_path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("rel_path", "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_island")


def read_snippets(corpus: DataFrame, ranges: DataFrame, most: int = 300) -> DataFrame:
    """The redacted lines of merged ranges, most lines of each at most; lines count from 0."""
    merged = merge_snippets(ranges)
    lines = F.split(redact(F.col("rel_path"), F.col("text")), "\n")
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    return merged.join(corpus, "rel_path").select("rel_path", "start_line", "end_line", F.array_join(F.slice(lines, F.col("start_line") + 1, n), "\n").alias("snippet"), F.sha2(F.concat_ws(":", "rel_path", "start_line", "end_line"), 256).alias("ref"))


def file_digest(corpus: DataFrame) -> DataFrame:
    """Language, lines, bytes, and lines that import or export."""
    from quillon.functions.globs import language

    lines = F.split("text", "\n")
    imports = r"^\s*(import\s|from\s+\S+\s+import\s|#include|using\s|(const|let|var)\s.*=\s*require\()"
    exports = r"^\s*(export\s|module\.exports|__all__|public\s)"
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return corpus.select("rel_path", language(F.col("rel_path")).alias("language"), F.size(lines).alias("lines"), F.octet_length("text").cast("long").alias("bytes"), n(imports).alias("import_lines"), n(exports).alias("export_lines"))


def gram_hit(grams: Column, r: Request) -> Column:
    """Whether an entry with these grams may match: it has every gram of one of the sets of the plan. For rows that no index holds."""
    sets = plan(r)
    if sets is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.size(F.array_except(F.array(*(F.lit(g) for g in sorted(s))), grams)) == 0 for s in sets])


def with_stale(found: DataFrame, docs: DataFrame, dirty: DataFrame) -> DataFrame:
    """Candidates with the documents of dirty(rel_path), whose grams may be out of date: these are always looked at."""
    return found.select("doc_id").unionByName(docs.join(dirty, "rel_path", "left_semi").select("doc_id")).distinct()


def live_postings(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of documents that are there: those of removed ones stay in the files until the next build."""
    return postings.join(docs.select("doc_id"), "doc_id", "left_semi").select("gram", "doc_id")


def file_priority(path: Column, opened: list[str]) -> Column:
    """Order of files in a listing: open ones, then own files by depth, then library paths."""
    return F.when(path.isin(opened), 0).when(is_library(path), 1000 + depth(path)).otherwise(1 + depth(path))


def merge_by_file(matches: DataFrame) -> DataFrame:
    """rel_path, n and places: the matches of a page by file, in the order of their places. For pages, whose size is bounded."""
    place = F.struct("line", "start_column", "end_line", "end_column")
    return matches.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(place)).alias("places"))


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset of a cursor; 0 for none, an error for what is not one."""
    if not cursor:
        return 0
    try:
        offset = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["offset"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor: {cursor}") from e
    if not isinstance(offset, int) or offset < 0:
        raise ValueError(f"not a cursor: {cursor}")
    return offset


def chunks(matches: Iterator, most: int = 200, most_chars: int = 1 << 16) -> Iterator[list]:
    """Rows with a preview, in runs of so many rows and characters at most: for a page that is shown as it arrives."""
    held, size = [], 0
    for row in matches:
        n = len(row["preview"] or "")
        if held and (len(held) >= most or size + n > most_chars):
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
