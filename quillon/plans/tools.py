"""Named requests over a workspace, as an agent or a command line makes them: each is a composition of operators.

`Workspace(...).call("search_code", query="x")` gives a DataFrame; `call_json` the same as rows of JSON. Requests that need an
index or a graph say so when the workspace has none. Editor diagnostics have no data source here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.globs import Scope, language
from quillon.operators import build, graph, search
from quillon.plans.query import Request, request
from quillon.sources import corpus as sources
from quillon.sources import symbols as symbols_
from quillon.sources.store import keep
from quillon.streaming import overlay as changes_

#: Other names of the same requests.
ALIASES = {"call_graph_info": "graph_info", "resolve_symbol": "search_symbols", "get_callers": "callers_summary", "get_callees": "callees", "get_implementations": "find_implementations", "get_usages": "find_references", "get_context_bundle": "context_bundle", "rebuild_call_graph": "rebuild_graph", "mcp_health": "health", "mcp_test": "test"}
SNIPPET_LINES = 300


@dataclass
class Workspace:
    """corpus(doc_id, rel_path, text, size_bytes); docs and postings of an index; the tables of `build.read_graph`; overlay rows."""

    corpus: DataFrame
    docs: DataFrame | None = None
    postings: DataFrame | None = None
    graph: dict[str, DataFrame] | None = None
    overlay: DataFrame | None = None

    def call(self, name: str, **arguments) -> DataFrame:
        plain = ALIASES.get(name, name)
        if plain not in REQUESTS:
            raise ValueError(f"no such request: {name}")
        return REQUESTS[plain](self, **arguments)

    def call_json(self, name: str, **arguments) -> DataFrame:
        return sources.to_json(self.call(name, **arguments))

    def table(self, name: str) -> DataFrame:
        if self.graph is None:
            raise ValueError("this request needs a graph; build one with build.write_graph")
        return self.graph[name]

    def rows(self, r: Request) -> DataFrame:
        """What a search must verify: the candidates of the index, or all; under an overlay, those it does not shadow and its live entries."""
        base = self.corpus if self.docs is None else search.pruned(self.corpus, self.docs, self.postings, r)
        if self.overlay is None:
            return base
        now = changes_.latest(self.overlay)
        kept = base.join(now, "rel_path", "left_anti").select("rel_path", "text", "size_bytes")
        live = now.where("not tombstone")
        if "grams" in live.columns:
            live = live.where(search.gram_hit(F.col("grams"), r))
        return kept.unionByName(live.select("rel_path", "text", F.octet_length("text").cast("long").alias("size_bytes")))

    def counts(self, query: str, **options) -> tuple[DataFrame, Request]:
        r = _request(query, **options)
        return search.occurrence_counts(self.rows(r), r), r


REQUESTS = {}


def named(f):
    REQUESTS[f.__name__] = f
    return f


def _request(query: str, **options) -> Request:
    if isinstance(options.get("scope"), (str, list)):
        options["scope"] = Scope.parse(options["scope"])
    return request(query, **options)


def _metrics(df: DataFrame, **columns: Column) -> DataFrame:
    """One row of aggregates as (metric, value) rows."""
    one = df.agg(*(c.cast("long").alias(n) for n, c in columns.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in columns))).alias("x")).select("x.*")


@named
def workspace_overview(w: Workspace) -> DataFrame:
    out = w.corpus.groupBy(language(F.col("rel_path")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    if w.graph:
        out = out.join(w.table("symbols").groupBy("language").agg(F.count(F.lit(1)).alias("symbols")), "language", "left")
    return out.orderBy(F.desc("files"), "language")


@named
def index_status(w: Workspace) -> DataFrame:
    n = F.count(F.lit(1))
    out = _metrics(w.corpus, files=n, bytes=F.coalesce(F.sum("size_bytes"), F.lit(0)))
    if w.docs is not None:
        out = out.unionAll(_metrics(w.docs, indexed=n, incomplete=F.count_if("gram_incomplete"))).unionAll(_metrics(w.postings, postings=n, grams=F.countDistinct("gram")))
    if w.overlay is not None:
        out = out.unionAll(_metrics(changes_.latest(w.overlay), live=F.count_if(~F.col("tombstone")), tombstones=F.count_if("tombstone")))
    return out


@named
def health(w: Workspace) -> DataFrame:
    flags = {"corpus": True, "index": w.docs is not None, "graph": w.graph is not None, "overlay": w.overlay is not None}
    return w.corpus.sparkSession.createDataFrame(list(flags.items()), "part string, ready boolean")


@named
def search_code(w: Workspace, query: str, limit: int = 50, offset: int = 0, cursor: str | None = None, **options) -> DataFrame:
    r, offset = _request(query, **options), search.decode_cursor(cursor) or offset
    out = search.page(search.match_positions(w.rows(r), r), limit, offset)
    return out.withColumn("preview", search.redact(F.col("rel_path"), F.col("preview")))


@named
def count(w: Workspace, query: str, **options) -> DataFrame:
    return search.count_by_file(w.counts(query, **options)[0])


@named
def bounded_count(w: Workspace, query: str, most: int = 10000, **options) -> DataFrame:
    return search.bounded_count(w.counts(query, **options)[0], most)


@named
def probe(w: Workspace, query: str, **options) -> DataFrame:
    return search.probe(w.counts(query, **options)[0])


@named
def exists(w: Workspace, query: str, **options) -> DataFrame:
    r = _request(query, **options)
    return search.exists(w.rows(r), r)


@named
def files(w: Workspace, query: str, **options) -> DataFrame:
    return w.counts(query, **options)[0].select("rel_path").orderBy("rel_path")


@named
def first(w: Workspace, query: str, **options) -> DataFrame:
    r = _request(query, **options)
    return search.match_positions(w.rows(r), r).orderBy("rel_path", "line", "start_column").limit(1)


@named
def top_files(w: Workspace, query: str, limit: int = 20, **options) -> DataFrame:
    return count(w, query, **options).limit(limit)


@named
def explain_search_query(w: Workspace, query: str, **options) -> DataFrame:
    if w.docs is None:
        raise ValueError("this request needs an index")
    return search.explain(w.docs, w.postings, _request(query, **options))


@named
def test(w: Workspace, query: str, **options) -> DataFrame:
    """The pruned search against a full scan."""
    found, r = w.counts(query, **options)
    return search.quality(found, search.occurrence_counts(w.corpus, r))


@named
def file_digest(w: Workspace, path: str | None = None) -> DataFrame:
    out = search.file_digest(w.corpus.where(F.col("rel_path") == path) if path else w.corpus)
    return out.join(w.table("symbols").groupBy("rel_path").agg(F.count(F.lit(1)).alias("symbols")), "rel_path", "left") if w.graph else out


@named
def exports(w: Workspace, path: str | None = None) -> DataFrame:
    s = w.table("symbols")
    return build.exported(s.where(F.col("rel_path") == path) if path else s).select("rel_path", "name", "kind", "start_line", "signature").orderBy("rel_path", "start_line")


@named
def imports(w: Workspace, path: str | None = None) -> DataFrame:
    parts = build.imports(w.table("extracts"))
    return (parts.where(F.col("rel_path") == path) if path else parts).orderBy("rel_path", "line", "local_name")


@named
def changed(w: Workspace, changes: DataFrame) -> DataFrame:
    """The symbols of the files in changes(kind, rel_path, ...); files without symbols have one row of nulls."""
    return changes.select("rel_path", F.col("kind").alias("change")).join(w.table("symbols").select("rel_path", "id", "name", "kind", "start_line"), "rel_path", "left").orderBy("rel_path", "start_line")


def _slice(w: Workspace, rows: DataFrame, most_lines: int | None = SNIPPET_LINES) -> DataFrame:
    lines = F.split(search.redact(F.col("rel_path"), F.col("text")), "\n")
    length = F.col("end_line") - F.col("start_line") + 1
    length = length if most_lines is None else F.least(length, F.lit(most_lines))
    return rows.join(w.corpus.select("rel_path", "text"), "rel_path").select("id", "rel_path", "start_line", "end_line", F.array_join(F.slice(lines, F.col("start_line") + 1, length), "\n").alias("snippet"))


@named
def symbol_slice(w: Workspace, symbol_id: str) -> DataFrame:
    return _slice(w, w.table("symbols").where(F.col("id") == symbol_id))


@named
def signature(w: Workspace, symbol_id: str) -> DataFrame:
    return w.table("symbols").where(F.col("id") == symbol_id).select("id", "kind", "qualified_name", "signature")


@named
def search_symbols(w: Workspace, query: str, limit: int = 50, mode: str = "auto", kinds: list[str] | None = None, languages: list[str] | None = None, container: str | None = None, framework: str | None = None) -> DataFrame:
    s = w.table("symbols").where(graph.match_mode(query, mode))
    s = s.where(F.col("kind").isin(*kinds)) if kinds else s
    s = s.where(F.col("language").isin(*languages)) if languages else s
    s = s.where(graph.in_container(container)) if container else s
    s = s.where(F.array_contains("markers", framework)) if framework else s
    return graph.search_symbols(s, query, limit)


@named
def outline(w: Workspace, most_files: int = 50, most_symbols: int = 50) -> DataFrame:
    return graph.outline(w.table("symbols"), most_files, most_symbols)


@named
def document_symbols(w: Workspace, path: str, start: int = 0, end: int = 1 << 30) -> DataFrame:
    return graph.document_symbols(w.table("symbols"), path, start, end)


@named
def resolve_at(w: Workspace, path: str, line: int, column: int) -> DataFrame:
    """What stands at a place: the symbols that a name there refers to, else the one declared there, else the innermost around."""
    s = w.table("symbols").where(F.col("rel_path") == path)
    at = w.table("refs").where((F.col("rel_path") == path) & (F.col("line") == line) & (F.col("column") <= column) & (column < F.col("column") + F.length("name")))
    named_ = at.select(F.col("target_symbol_id").alias("id"), F.lit(0).alias("tier"))
    declared = s.where((F.col("start_line") == line) & (F.col("start_column") <= column) & (column < F.col("start_column") + F.length("name"))).select("id", F.lit(1).alias("tier"))
    around = s.where(F.lit(line).between(F.col("start_line"), F.col("end_line"))).orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line")).limit(1).select("id", F.lit(2).alias("tier"))
    found = named_.unionAll(declared).unionAll(around)
    best = found.agg(F.min("tier").alias("tier"))
    return w.table("symbols").join(found.join(best, "tier", "left_semi").select("id", "tier"), "id")


@named
def symbol_details(w: Workspace, symbol_id: str) -> DataFrame:
    s = w.table("symbols").where(F.col("id") == symbol_id)
    used = w.table("refs").where(F.col("target_symbol_id") == symbol_id)
    sums = graph.relation_summary(used).withColumnRenamed("target_symbol_id", "id")
    made = find_implementations(w, symbol_id).agg(F.count(F.lit(1)).alias("implementations")).withColumn("id", F.lit(symbol_id))
    return s.join(sums, "id", "left").join(made, "id", "left").withColumn("implementations", F.col("implementations") + F.size("markers"))


@named
def find_references(w: Workspace, symbol_id: str, limit: int = 200, group_by: str | None = None) -> DataFrame:
    refs = w.table("refs")
    return graph.group_references(refs.where(F.col("target_symbol_id") == symbol_id), group_by) if group_by else graph.usages(refs, symbol_id, limit)


@named
def find_implementations(w: Workspace, symbol_id: str) -> DataFrame:
    """Of a type its descendants, of a member those of the same name in descendants of its type."""
    s, closure = w.table("symbols"), w.table("hierarchy")
    one = s.where(F.col("id") == symbol_id)
    types = closure.where(F.col("ancestor") == symbol_id).select(F.col("descendant").alias("id"))
    below = one.where(F.col("kind").isin(*graph.MEMBERS)).select("name", F.col("container_id").alias("ancestor")).join(closure, "ancestor").select("name", F.col("descendant").alias("container_id"))
    members = s.where(F.col("kind").isin(*graph.MEMBERS)).join(below, ["name", "container_id"], "left_semi").select("id")
    return s.join(types.unionAll(members).distinct(), "id", "left_semi").orderBy("rel_path", "start_line")


def _edges(w: Workspace) -> DataFrame:
    """Calls, constructs and usages, and the relations of types (implements) and of their members (overrides)."""
    s, closure = w.table("symbols"), w.table("hierarchy")
    used = w.table("refs").where("enclosing_symbol_id is not null").select(F.col("enclosing_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "edge_kind")
    types = graph.parents(s).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("implements").alias("edge_kind"))
    members = graph.member_implementations(s, closure).select(F.col("implementation").alias("src"), F.col("id").alias("dst"), F.lit("overrides").alias("edge_kind"))
    return used.unionByName(types).unionByName(members)


@named
def graph_neighbors(w: Workspace, symbol_id: str, depth: int = 1, kinds: list[str] | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    return graph.neighbours(_edges(w), symbol_id, depth, kinds, direction, limit)


@named
def graph_info(w: Workspace) -> DataFrame:
    return graph.graph_info(w.table("symbols"))


@named
def callers_summary(w: Workspace, symbol_id: str, by_file: bool = False) -> DataFrame:
    return graph.callers_summary(w.table("refs"), symbol_id, by_file)


@named
def callees(w: Workspace, symbol_id: str) -> DataFrame:
    return graph.callees(w.table("refs"), symbol_id).orderBy("line", "column")


@named
def inlay_counts(w: Workspace, path: str, start: int = 0, end: int = 1 << 30) -> DataFrame:
    """Usages and implementations of the symbols in a range of a file."""
    s = graph.document_symbols(w.table("symbols"), path, start, end).where("kind not in ('constant', 'variable')")
    used = graph.usage_counts(s, w.table("refs"))
    types = w.table("hierarchy").select(F.col("ancestor").alias("id"))
    members = graph.member_implementations(w.table("symbols"), w.table("hierarchy")).select("id")
    made = types.unionAll(members).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(used, "id").join(made, "id", "left").select("id", "start_line", "usage_count", (F.coalesce("n", F.lit(0)) + F.size("markers")).cast("long").alias("implementation_count")).orderBy("start_line")


@named
def context_bundle(w: Workspace, query: str, most_chars: int | None = None) -> DataFrame:
    """The best symbol of a query: its name, callers and callees, and then its redacted source, whole or within a number of characters."""
    target = search_symbols(w, query, 1).select("id")
    told = graph.context_bundle(target, w.table("refs"), w.table("symbols"), most_chars).drop("tokens")
    source = _slice(w, w.table("symbols").join(target, "id", "left_semi"), None).select("id", "snippet")
    text = F.concat_ws("\n", "bundle", "snippet")
    text = text if most_chars is None else F.substring(text, 1, most_chars)
    return told.join(source, "id", "left").select("id", text.alias("bundle"), F.ceil(F.length(text) / 4).cast("long").alias("tokens"))


@named
def graph_edges(w: Workspace, symbol_id: str, depth: int = 1, kinds: list[str] | None = None, direction: str = "both", limit: int | None = None, most_edges: int | None = None) -> DataFrame:
    """The edges among the neighbours of a symbol, in the order of their ends: all, or most_edges of them."""
    near = keep(graph_neighbors(w, symbol_id, depth, kinds, direction, limit).select("node"))
    edges = _edges(w)
    edges = edges.where(F.col("edge_kind").isin(*kinds)) if kinds else edges
    inside = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = inside.select("src", "dst", "edge_kind").distinct().orderBy("src", "dst", "edge_kind")
    return out if most_edges is None else out.limit(most_edges)


@named
def update_graph(w: Workspace, changed: DataFrame) -> DataFrame:
    """The graph after the files of changed(rel_path, text) were read again; a null text is a file that is gone."""
    paths = changed.select("rel_path")
    new = keep(build.symbols(keep(symbols_.extracts(changed.where("text is not null")))))
    old = w.table("symbols")
    s = keep(graph.update_symbols(old, new.select(*old.columns), paths))
    parts = w.table("extracts").join(paths, "rel_path", "left_anti").unionByName(symbols_.extracts(changed.where("text is not null")), allowMissingColumns=True)
    parts = keep(parts)
    closure = graph.descendants(graph.parents(s))
    refs = keep(build.references(parts, s, closure))
    w.graph = {"extracts": parts, "symbols": s, "hierarchy": closure, "refs": refs}
    return graph_info(w)


@named
def read_snippets(w: Workspace, ranges: list[tuple[str, int, int]]) -> DataFrame:
    rows = w.corpus.sparkSession.createDataFrame(ranges, "rel_path string, start_line int, end_line int")
    return search.read_snippets(w.corpus, rows, SNIPPET_LINES)


@named
def refresh_index(w: Workspace, changes: DataFrame) -> DataFrame:
    """The overlay rows of a batch of changes, with their grams. Searches of this workspace see them from here on."""
    rows = keep(changes_.with_grams(changes_.apply_batch(changes, w.corpus)))
    w.overlay = rows if w.overlay is None else w.overlay.unionByName(rows, allowMissingColumns=True)
    return rows


@named
def rebuild_graph(w: Workspace, path: str) -> DataFrame:
    build.write_graph(w.corpus, path)
    w.graph = build.read_graph(w.corpus.sparkSession, path)
    return graph_info(w)
