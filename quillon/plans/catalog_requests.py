"""More registered queries, with SQL: named requests over workspaces, files, freshness, and sources in several languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import globs, grams
from quillon.operators import build, graph, search
from quillon.plans import catalog, tools
from quillon.plans.catalog import COUNT, DOCS, FEED, GRAMS, PLACES, RANKED, SOURCES, SQL, SYMBOLS, _feed, _grams_of, _index, _refs, _sets, _symbols, _table, query
from quillon.plans.query import request
from quillon.sources import corpus, store
from quillon.sources import symbols as source
from quillon.streaming import overlay


def _same(name, columns, call):
    """A request whose rows are those of another query."""

    def f(spark, sf):
        return call(spark, sf).select(*columns)

    f.__name__ = name
    return f


def _files(spark, sf):
    """The documents and their index."""
    return tools.Workspace(corpus.of_documents(spark, sf), *_index(spark, sf))


def _orders(spark, sf):
    """Parts as symbols, order items as references."""
    s = _symbols(spark, sf).withColumn("signature", F.concat(F.lit("def "), "name"))
    return tools.Workspace(corpus.of_documents(spark, sf), graph={"symbols": s, "refs": _refs(spark, sf)})


for _name, _sql, _columns, _work, _arguments in [
    ("count", "count_by_file", ["rel_path", "matches"], _files, {"query": "tion"}),
    ("bounded_count", "bounded_count", ["total", "exact"], _files, {"query": "tion", "most": 1000}),
    ("probe", "probe", ["total", "files"], _files, {"query": "tion"}),
    ("exists", "exists", ["found"], _files, {"query": "tion"}),
    ("files", "files", ["rel_path"], _files, {"query": "tion"}),
    ("top_files", "top_files", ["rel_path", "matches"], _files, {"query": "tion"}),
    ("explain_search_query", "explain_counts", ["gram", "df", "candidates"], _files, {"query": "apache license"}),
    ("test", "search_quality", ["overlap", "missing", "extra", "recall", "precision"], _files, {"query": "apache license"}),
    ("search_code", "search_ranked", ["rel_path", "score", "line", "start_column"], _files, {"query": "license", "limit": 25, "cursor": search.encode_cursor(5)}),
    ("search_symbols", "symbol_search", ["id", "score"], _orders, {"query": "red", "limit": 50}),
    ("document_symbols", "document_symbols", ["id", "start_line"], _orders, {"path": "Brand#13", "start": 10, "end": 1000}),
    ("outline", "outline_caps", ["rel_path", "id", "name", "place"], _orders, {"most_files": 5, "most_symbols": 10}),
    ("find_references", "usages", ["rel_path", "line", "column", "total"], _orders, {"symbol_id": "part:7", "limit": 20}),
    ("callers_summary", "callers_summary", ["caller", "n"], _orders, {"symbol_id": "part:11"}),
    ("callees", "callees", ["target_symbol_id", "edge_kind", "column"], _orders, {"symbol_id": "order:7"}),
    ("graph_info", "graph_info", ["language", "kind", "n"], _orders, {}),
]:
    query(SQL[_sql])(_same(f"tool_{_name}", _columns, lambda spark, sf, work=_work, name=_name, arguments=_arguments: work(spark, sf).call(name, **arguments)))


@query(DOCS + PLACES + "select rel_path, line, start_column from q order by rel_path, line, start_column limit 1")
def tool_first(spark, sf):
    return _files(spark, sf).call("first", query="license").select("rel_path", "line", "start_column")


@query(DOCS + "select rel_path, 'text' as language, cast(len(string_split(text, chr(10))) as integer) as lines, size_bytes as bytes from c where text is not null")
def tool_file_digest(spark, sf):
    return _files(spark, sf).call("file_digest").where("bytes is not null").select("rel_path", "language", "lines", "bytes")


@query(DOCS + "select 'text' as language, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from c")
def tool_workspace_overview(spark, sf):
    return _files(spark, sf).call("workspace_overview")


@query(GRAMS + """, m(metric, value) as (select 'files', count(*) from c union all select 'bytes', cast(sum(size_bytes) as bigint) from c union all select 'indexed', count(*) from c union all select 'incomplete', 0
  union all select 'postings', count(*) from g union all select 'grams', count(distinct gram) from g) select metric, cast(value as bigint) as value from m""")
def tool_index_status(spark, sf):
    return _files(spark, sf).call("index_status")


@query("select * from (values ('corpus', true), ('index', true), ('graph', false), ('overlay', false)) as t(part, ready)")
def tool_health(spark, sf):
    return _files(spark, sf).call("mcp_health")


@query(SYMBOLS + "select id, kind, qualified_name, 'def ' || name as signature from y where id = 'part:11'")
def tool_signature(spark, sf):
    return _orders(spark, sf).call("signature", symbol_id="part:11")


@query(DOCS + COUNT + """, x as (select rel_path, coalesce(matches, 0) as matches, cast(split_part(split_part(rel_path, '/', 3), '.', 1) as bigint) as id from n)
select rel_path, matches from x where matches > 0 and id % 7 <> 0""")
def tool_refresh_index(spark, sf):
    """A search after a refresh that deleted every seventh document and read every fifth again."""
    w = _files(spark, sf)
    d = w.corpus.where("doc_id % 7 = 0 or doc_id % 5 = 0")
    kind = F.when(F.col("doc_id") % 7 == 0, "delete").otherwise("modify")
    w.call("refresh_index", changes=d.select(kind.alias("kind"), "rel_path", F.lit(None).cast("string").alias("new_rel_path"), F.lit(1).cast("long").alias("generation"), F.col("doc_id").cast("long").alias("seq")))
    return w.call("count", query="tion").select("rel_path", "matches")


SNIPPET_REDACTED = SQL["redact"].removeprefix(DOCS)


@query(DOCS + f", t as ({SNIPPET_REDACTED}) select rel_path, 1 as start_line, 3 as end_line, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as snippet from t where text is not null")
def read_snippets(spark, sf):
    c = corpus.of_documents(spark, sf).where("text is not null")
    ranges = c.select("rel_path", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")), F.struct(F.lit(3).alias("a"), F.lit(3).alias("b")))).alias("x")).select("rel_path", F.col("x.a").alias("start_line"), F.col("x.b").alias("end_line"))
    return search.read_snippets(c, ranges).select("rel_path", "start_line", "end_line", "snippet")


@query(DOCS + PLACES + """, o as (select rel_path, line, start_column, row_number() over (order by rel_path, line, start_column) as k from q), w as (select rel_path, line, start_column from o where k <= 31),
s as (select *, cast(100 * count(*) over (partition by rel_path) - 3 * (length(rel_path) - length(replace(rel_path, '/', ''))) - octet_length(encode(rel_path)) as bigint) as score from w)
select rel_path, score, line, start_column from s order by score desc, rel_path, line, start_column limit 20 offset 10""")
def early_page(spark, sf):
    rows = search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal"))
    return search.early_page(rows, 20, 10).select("rel_path", "score", "line", "start_column")


@query(DOCS + PLACES + RANKED + ", t as (select * from s order by score desc, rel_path, line, start_column limit 40) select rel_path, count(*) as n, cast(list(line order by line, start_column) as varchar) as lines from t group by 1")
def merge_by_file(spark, sf):
    rows = search.page(search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal")), 40)
    lines = F.array_join(F.col("places.line").cast("array<string>"), ", ")
    return search.merge_by_file(rows).select("rel_path", "n", F.concat(F.lit("["), lines, F.lit("]")).alias("lines"))


PATHS = "case c_custkey % 6 when 0 then 'node_modules/x' when 1 then 'src' when 2 then 'a/b/c' when 3 then 'dist' when 4 then 'venv/lib' else '' end"


def _paths(spark, sf):
    k = F.col("c_custkey") % 6
    folder = F.when(k == 0, "node_modules/x/").when(k == 1, "src/").when(k == 2, "a/b/c/").when(k == 3, "dist/").when(k == 4, "venv/lib/").otherwise("")
    return _table(spark, sf, "customer").select("c_custkey", F.concat(folder, "c_name").alias("rel_path"))


@query("select c_custkey, c_custkey % 6 in (0, 3, 4) as library from customer")
def library_paths(spark, sf):
    return _paths(spark, sf).select("c_custkey", globs.is_library(F.col("rel_path")).alias("library"))


@query("select c_custkey, cast(case when c_custkey = 7 then 0 when c_custkey % 6 = 0 then 1002 when c_custkey % 6 = 3 then 1001 when c_custkey % 6 = 4 then 1002 when c_custkey % 6 = 1 then 2 when c_custkey % 6 = 2 then 4 else 1 end as integer) as priority from customer")
def file_priority(spark, sf):
    opened = [r[0] for r in _paths(spark, sf).where("c_custkey = 7").select("rel_path").collect()]
    return _paths(spark, sf).select("c_custkey", search.file_priority(F.col("rel_path"), opened).cast("int").alias("priority"))


@query(DOCS + r"""
, t as (select doc_id, 'path' as kind, unnest(regexp_split_to_array(lower(rel_path), '[^\p{L}\p{N}_]+')) as t from c union all select doc_id, case when length(t) <= 4 then 'short' when length(t) <= 8 then 'medium' else 'long' end, t from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) as t from c)),
g as (select distinct doc_id, kind, substr(t, i.i, w.w) as gram from t, (values (2), (3), (4)) as w(w), unnest(range(1, length(t) - w.w + 2)) as i(i))
select kind, count(*) as n, count(distinct gram) as grams from g group by 1""")
def typed_grams(spark, sf):
    g = corpus.typed_gram_df(store.spread(corpus.of_documents(spark, sf), "doc_id"))
    return g.groupBy("kind").agg(F.sum("df").alias("n"), F.count(F.lit(1)).alias("grams"))


# files


@query("select n_nationkey as nation, n_name || chr(10) || 'second' || chr(10) as text, cast(octet_length(encode(n_name)) + 8 as bigint) as size_bytes, 'utf-8' as encoding from nation where n_nationkey % 5 <> 4")
def scan_files(spark, sf):
    """A folder of small files, one of five in a folder that the scope leaves out."""
    path = _folder(spark, sf)
    rows = corpus.scan(spark, path, globs.Scope.parse("!four/"))
    return rows.select(F.regexp_extract("rel_path", r"nation=(\d+)/", 1).cast("int").alias("nation"), "text", "size_bytes", "encoding")


def _folder(spark, sf):
    path = store.new_path(spark, "files")
    n = _table(spark, sf, "nation")
    kind = F.when(F.col("n_nationkey") % 5 == 4, "four").otherwise("other")
    rows = n.select(F.concat("n_name", F.lit("\nsecond")).alias("value"), kind.alias("kind"), F.col("n_nationkey").alias("nation"))
    for name in ("four", "other"):
        rows.where(F.col("kind") == name).drop("kind").write.partitionBy("nation").text(f"{path}/{name}")
    return path


@query("select 25 as files, 25 as indexed, 0 as skipped_binary")
def scan_stats(spark, sf):
    """Files by what becomes of them; markers and checksums that the writer leaves are hidden files."""
    path = _folder(spark, sf)
    s = corpus.scan_stats(spark, path)
    n = corpus.count_files(spark, path)
    return n.crossJoin(F.broadcast(s)).select(F.col("files").cast("int").alias("files"), F.col("indexed").cast("int").alias("indexed"), F.col("skipped_binary").cast("int").alias("skipped_binary"))


def _contents(spark, sf):
    """One file for each part: plain, with a byte order mark, with a zero byte, with a name of no text, in the index's own folder, or large."""
    p, k = _table(spark, sf, "part"), F.col("p_partkey") % 7
    name = F.col("p_name").cast("binary")
    wide = lambda charset: F.encode("p_name", charset)
    mark = lambda x: F.unhex(F.lit(x))
    content = F.when(k == 1, F.concat(mark("EFBBBF"), name)).when(k == 2, F.concat(mark("FFFE"), wide("UTF-16LE"))).when(k == 3, F.concat(mark("FEFF"), wide("UTF-16BE"))).when(k == 4, F.concat(name, mark("00"), name)).otherwise(name)
    path = F.concat(F.lit("file:/root/w/"), F.when(k == 5, ".git/").otherwise("src/"), F.col("p_partkey").cast("string"), F.when(k == 6, ".png").otherwise(".txt"))
    rows = p.select("p_partkey", path.alias("path"), F.when(F.col("p_size") > 45, 2 << 20).otherwise(100).cast("long").alias("length"), content.alias("content"))
    return corpus.classify(rows, "/root/w")


FATES = "case when p_partkey % 7 = 5 then 'index_folder' when p_partkey % 7 = 6 then 'binary_extension' when p_size > 45 then 'too_large' when p_partkey % 7 = 4 then 'binary' else 'text' end"


@query(f"select {FATES} as fate, count(*) as files from part group by 1")
def file_fates(spark, sf):
    return _contents(spark, sf).groupBy("fate").agg(F.count(F.lit(1)).alias("files"))


@query(f"select p_partkey, p_name as text, case p_partkey % 7 when 1 then 'utf-8-bom' when 2 then 'utf-16le' when 3 then 'utf-16be' else 'utf-8' end as encoding from part where {FATES} = 'text'")
def decoded_files(spark, sf):
    return _contents(spark, sf).where("fate = 'text'").select("p_partkey", corpus.decode(F.col("content")).alias("text"), corpus.encoding(F.col("content")).alias("encoding"))


@query(SYMBOLS + "select target_symbol_id, rel_path, line, edge_kind, enclosing_symbol_id from r")
def usages_import(spark, sf):
    """References written as tab-separated, percent-encoded rows and read back."""
    path = store.new_path(spark, "usages")
    text = lambda c: F.coalesce(F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    blank = F.lit("")
    row = [F.lit("U"), text("target_symbol_id"), blank, blank, blank, text("rel_path"), F.col("line").cast("string"), F.col("column").cast("string"), F.col("line").cast("string"), F.col("column").cast("string"), text("enclosing_symbol_id"), F.col("edge_kind")]
    _refs(spark, sf).select(F.concat_ws("\t", *row).alias("value")).write.text(path)
    return corpus.read_usages(spark, path).select("target_symbol_id", "rel_path", F.col("start_line").alias("line"), "edge_kind", "enclosing_symbol_id")


@query(SYMBOLS + "select '{\"id\":\"' || id || '\",\"start_line\":' || cast(start_line as varchar) || '}' as json from y")
def response_json(spark, sf):
    return corpus.to_json(_symbols(spark, sf).select("id", "start_line"))


# freshness


@query(FEED + ", l as (select * from o where k = 1 and not tombstone and contains(text, 'purchase:')) select rel_path from l")
def overlay_candidates(spark, sf):
    """Live entries whose grams allow a match, and then those that do match."""
    live = overlay.with_grams(overlay.latest(_feed(spark, sf)).where("not tombstone"))
    r = request("purchase:", kind="literal", case="sensitive")
    return live.where(search.gram_hit(F.col("grams"), r)).where(search.contains_any(F.col("text"), r)).select("rel_path")


@query(GRAMS + "select doc_id from c where doc_id % 50 = 0 or " + _sets(request("apache license", kind="literal")))
def stale_candidates(spark, sf):
    docs, posts = _index(spark, sf)
    dirty = docs.where("doc_id % 50 = 0").select("rel_path")
    return search.with_stale(search.candidates(docs, posts, request("apache license", kind="literal")), docs, dirty)


@query(GRAMS + "select gram, count(*) as df from g where doc_id % 3 <> 0 and gram in (" + ", ".join(f"'{x}'" for x in sorted(_grams_of("apache license"))) + ") group by 1")
def live_postings(spark, sf):
    docs, posts = _index(spark, sf)
    wanted = posts.where(F.col("gram").isin(*sorted(_grams_of("apache license"))))
    return search.live_postings(wanted, docs.where("doc_id % 3 <> 0")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


@query(FEED + "select cast(max(generation) + 1 as bigint) as generation from o")
def next_generation(spark, sf):
    return spark.range(1).select(F.lit(overlay.next_generation(_feed(spark, sf))).cast("long").alias("generation"))


def _written_feed(spark, sf):
    """The feed in three batches of the overlay's own layout."""
    path = store.new_path(spark, "overlay")
    for k in range(3):
        _feed(spark, sf).where(F.col("generation") % 3 == k).write.parquet(f"{path}/batch={k}")
    return path


@query(FEED + "select rel_path, generation, tombstone, text from o where k = 1")
def overlay_compacted(spark, sf):
    path = _written_feed(spark, sf)
    overlay.compact(spark, path)
    return overlay.read(spark, path).select("rel_path", "generation", "tombstone", "text")


@query(SQL["compacted_corpus"])
def base_compacted(spark, sf):
    path = _written_feed(spark, sf)
    base = _table(spark, sf, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("rel_path"), F.concat(F.lit("purchase:"), "c_name").alias("text"))
    return overlay.compact_base(spark, base, path, store.new_path(spark, "base"))


@query("with e as (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id desc) as k from events) select 'user/' || cast(user_id as varchar) as rel_path, event_type as kind, event_id as generation from e where k = 1")
def pending_changes(spark, sf):
    e = _table(spark, sf, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("rel_path"), F.col("event_type").alias("kind"), F.col("event_id").alias("generation"), F.lit(0).alias("seq"))
    return overlay.coalesce_pending(e).select("rel_path", "kind", "generation")


@query("select 'f' || cast(c_custkey as varchar) as rel_path, case when c_custkey % 4 = 3 then 'delete' else 'modify' end as kind from customer where c_custkey % 4 in (1, 2, 3)")
def reconciled(spark, sf):
    """Snapshots that differ: one file in four changed, one new, one gone."""
    c, k = _table(spark, sf, "customer"), F.col("c_custkey") % 4
    path = F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("rel_path")
    then = c.where(k != 2).select(path, F.lit(10).cast("long").alias("modified_unix_secs"))
    now = c.where(k != 3).select(path, F.when(k == 1, 20).otherwise(10).cast("long").alias("modified_unix_secs"))
    return overlay.reconcile(now, then)


@query(SYMBOLS + """, s as (select id, case when lower(qualified_name) = 'red' then 900 when lower(name) = 'red' then 800 when lower(qualified_name) like '%.red' then 750 when starts_with(lower(name), 'red') then 600 when contains(lower(qualified_name), 'red') then 400 when contains(lower(rel_path), 'red') then 100 else 0 end as score from y)
select id, score from s where score > 0""")
def fallback_scores(spark, sf):
    return _symbols(spark, sf).select("id", graph.fallback_score("red").alias("score")).where("score > 0")


# a workspace of Python sources

_graphs: dict[tuple[str, str], str] = {}


def _package(spark, sf):
    """The generated package with its graph, which is written once a session."""
    key = spark.sparkContext.applicationId, sf
    texts = store.keep(catalog._source_texts(spark, sf))
    w = tools.Workspace(texts.withColumns({"doc_id": F.xxhash64("rel_path"), "size_bytes": F.octet_length("text").cast("long")}))
    if key not in _graphs:
        _graphs[key] = store.new_path(spark, "graph")
        w.call("rebuild_graph", path=_graphs[key])
    w.graph = build.read_graph(spark, _graphs[key])
    return w


BASE_PATH, BASE_ID = "nation3/base.py", "python:nation3/base.py:Nation_3:1"
DESCRIBE_ID = "python:nation3/base.py:Nation_3.describe:2"
THREE = SOURCES + ", t as (select k, 'Supplier_' || cast(k as varchar) as name, rel_path, 'python:' || rel_path || ':Supplier_' || cast(k as varchar) || ':3' as id from s where n = 3), j as (select count(*) as n from t)\n"


@query(SOURCES + "select 'python' as language, kind, count(*) as n from y group by 2")
def tool_rebuild_graph(spark, sf):
    return _package(spark, sf).call("graph_info")


@query(SOURCES + "select rel_path, qualified_name as name from y where qualified_name not like '%.%'")
def tool_exports(spark, sf):
    return _package(spark, sf).call("exports").select("rel_path", "name")


@query(SOURCES + "select rel_path, 'Nation_' || cast(n as varchar) as local_name, 'nation' || cast(n as varchar) || '/base.py' as target_rel_path from s")
def tool_imports(spark, sf):
    return _package(spark, sf).call("imports").select("rel_path", "local_name", "target_rel_path")


@query(THREE + "select id, rel_path, name from t")
def tool_find_implementations(spark, sf):
    return _package(spark, sf).call("get_implementations", symbol_id=BASE_ID).select("id", "rel_path", "name")


@query(THREE + f"select '{BASE_ID}' as id, 2 * n as usages, n as implementations from j where n > 0 union all select '{BASE_ID}', null, 0 from j where n = 0")
def tool_symbol_details(spark, sf):
    return _package(spark, sf).call("symbol_details", symbol_id=BASE_ID).select("id", "usages", F.col("implementations").cast("long").alias("implementations"))


@query(f"select '{BASE_ID}' as id, '{BASE_PATH}' as rel_path, 0 as start_line, 2 as end_line, 'class Nation_3:' || chr(10) || '    def describe(self):' || chr(10) || '        return 3' as snippet")
def tool_symbol_slice(spark, sf):
    return _package(spark, sf).call("symbol_slice", symbol_id=BASE_ID)


@query(THREE + f"select '{BASE_ID}' as id, 1 as tier")
def tool_resolve_at(spark, sf):
    return _package(spark, sf).call("resolve_at", path=BASE_PATH, line=0, column=8).select("id", "tier")


@query(THREE + f"select '{BASE_ID}' as node, 0 as distance union all select id, 1 from t")
def tool_graph_neighbors(spark, sf):
    return _package(spark, sf).call("graph_neighbors", symbol_id=BASE_ID, kinds=["implements"]).select("node", "distance")


@query(THREE + f"select id as src, '{BASE_ID}' as dst, 'implements' as edge_kind from t")
def tool_graph_edges(spark, sf):
    return _package(spark, sf).call("graph_edges", symbol_id=BASE_ID, kinds=["implements"])


@query(THREE + f"select '{BASE_ID}' as id, 0 as start_line, 2 * n as usage_count, n as implementation_count from j union all select '{DESCRIBE_ID}', 1, n, 0 from j")
def tool_inlay_counts(spark, sf):
    return _package(spark, sf).call("inlay_counts", path=BASE_PATH)


@query(THREE + "select rel_path, 'modify' as change, split_part(qualified_name, '.', -1) as name from y where rel_path like 'nation3/%' union all select 'gone.py', 'delete', null")
def tool_changed(spark, sf):
    w = _package(spark, sf)
    changes = w.corpus.where("rel_path like 'nation3/%'").select("rel_path", F.lit("modify").alias("kind")).unionByName(spark.createDataFrame([("gone.py", "delete")], "rel_path string, kind string"))
    return w.call("changed", changes=changes).select("rel_path", "change", "name")


@query(THREE + f"select '{BASE_ID}' as id, 'class Nation_3' || (select coalesce(chr(10) || 'callers: ' || string_agg(x, ', ' order by x), '') from (select distinct name as x from t)) || chr(10) || 'class Nation_3:' || chr(10) || '    def describe(self):' || chr(10) || '        return 3' as bundle")
def tool_context_bundle(spark, sf):
    return _package(spark, sf).call("get_context_bundle", query="Nation_3").select("id", "bundle")


@query(SOURCES + """select * from (select 'python' as language, case when qualified_name = 'Nation_3.describe' then 'gone' else kind end as kind, count(*) as n from y group by 2) where kind <> 'gone' and n > 0""")
def tool_update_graph(spark, sf):
    """The graph after one method left its file: all others stay, and what referred to it is resolved anew."""
    w = _package(spark, sf)
    return w.call("update_graph", changed=spark.createDataFrame([(BASE_PATH, "class Nation_3:\n    pass\n")], "rel_path string, text string"))


# sources in other languages


def _polyglot(spark, sf):
    """For each region a Java, a TypeScript, a Kotlin and a GraphQL file."""
    r, k = _table(spark, sf, "region"), "r_regionkey"
    java = "@RestController\npublic class Store_%d extends Base implements Shelf {\n  private int size = %d;\n  public Store_%d(int n) { size = n; }\n  @GetMapping(\"/all\")\n  public int all(int n) {\n    return size;\n  }\n}\n"
    script = "import { helper as h } from './lib_%d';\nexport class View_%d extends Panel {\n  title = 1;\n  render(): void {\n    h(%d);\n  }\n}\nexport function make(n) {\n  return new View_%d();\n}\n"
    lib = "export function helper(k) {\n  return k;\n}\n"
    kotlin = "class Box_%d(val n: Int) : Base() {\n  fun open(x: Int): Int { return x }\n}\nfun top() = Box_%d(1)\n"
    schema = "type Query { me: User_%d }\ntype User_%d { name: String friend: User_%d }\nquery Q { me { friend { name } } }\n"
    one = lambda path, body: r.select(F.format_string(path, k).alias("rel_path"), F.format_string(body, *[k] * body.count("%d")).alias("text") if "%d" in body else F.lit(body).alias("text"))
    parts = [one("r%d/Store.java", java), one("r%d/view.ts", script), r.select(F.format_string("r%d/lib_%d.ts", k, k).alias("rel_path"), F.lit(lib).alias("text")), one("r%d/box.kt", kotlin), one("r%d/s.graphql", schema)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return store.keep(source.extracts(out))


POLYGLOT = """
with r as (select cast(r_regionkey as varchar) as k from region),
y as (select 'r' || k || replace(v.path, '#', k) as rel_path, replace(v.name, '#', k) as qualified_name, v.kind, v.line as start_line from r, (values
  ('/Store.java', 'Store_#', 'class', 1), ('/Store.java', 'Store_#.size', 'constant', 2), ('/Store.java', 'Store_#.Store_#', 'constructor', 3), ('/Store.java', 'Store_#.all', 'method', 5),
  ('/view.ts', 'View_#', 'class', 1), ('/view.ts', 'View_#.title', 'constant', 2), ('/view.ts', 'View_#.render', 'method', 3), ('/view.ts', 'make', 'function', 7), ('/lib_#.ts', 'helper', 'function', 0),
  ('/box.kt', 'Box_#', 'class', 0), ('/box.kt', 'Box_#.open', 'method', 1), ('/box.kt', 'top', 'function', 3),
  ('/s.graphql', 'Query', 'type', 0), ('/s.graphql', 'Query.me', 'method', 0), ('/s.graphql', 'User_#', 'type', 1), ('/s.graphql', 'User_#.name', 'method', 1), ('/s.graphql', 'User_#.friend', 'method', 1), ('/s.graphql', 'Q', 'function', 2)) as v(path, name, kind, line))
"""


@query(POLYGLOT + "select * from y")
def polyglot_symbols(spark, sf):
    return build.symbols(_polyglot(spark, sf)).select("rel_path", "qualified_name", "kind", "start_line")


@query(POLYGLOT + "select 'r' || k || '/view.ts' as rel_path, 'h' as local_name, 'helper' as imported_name, 'r' || k || '/lib_' || k || '.ts' as target_rel_path from r")
def script_imports(spark, sf):
    return build.imports(_polyglot(spark, sf)).select("rel_path", "local_name", "imported_name", "target_rel_path")


@query(POLYGLOT + "select 'Store_' || k as qualified_name, 'SpringBean' as marker from r union all select 'Store_' || k || '.all', 'SpringRoute' from r union all select 'Q', 'GraphQLOperation' from r")
def framework_markers(spark, sf):
    return build.symbols(_polyglot(spark, sf)).select("qualified_name", F.explode("markers").alias("marker"))


@query(POLYGLOT + "select 'r' || k || '/s.graphql' as rel_path, v.name, v.n from r, (values ('me', 1), ('friend', 1), ('name', 1)) as v(name, n)")
def graphql_references(spark, sf):
    parts = _polyglot(spark, sf)
    found = build.resolve_selections(parts, store.keep(build.symbols(parts)))
    return found.groupBy("rel_path", "name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(SOURCES + "select rel_path, 'describe' as name, 'self' as receiver, 7 as line from s")
def call_sites(spark, sf):
    return build.call_sites(catalog._sources(spark, sf)).where("name = 'describe'").select("rel_path", "name", "receiver", "line")


@query(SOURCES + "select 'python:' || rel_path || ':Supplier_' || cast(k as varchar) || '.run:7' as caller, 'python:nation' || cast(n as varchar) || '/base.py:Nation_' || cast(n as varchar) || '.describe:2' as callee_id from s")
def call_edges(spark, sf):
    """Call sites resolved to edges, written and read again."""
    parts = catalog._sources(spark, sf)
    s = store.keep(build.symbols(parts))
    calls = build.call_sites(parts).where("name = 'describe'")
    none = spark.createDataFrame([], "enclosing_symbol_id string, variable string, class_id string")
    edges = store.keep(graph.resolve_calls(calls, s, graph.descendants(graph.parents(s)), none), "calls")
    return edges.select(F.col("enclosing_symbol_id").alias("caller"), "callee_id")
