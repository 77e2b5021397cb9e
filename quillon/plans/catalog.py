"""Every registered query of the engine, with SQL that gives the same rows.

The tables stand in for corpora and graphs: documents and pages are files, events a change feed, regions to customers a type
hierarchy, orders symbols that enclose the references of lineitem to parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import globs, grams
from quillon.operators import build, graph, search
from quillon.plans.query import request
from quillon.sources import corpus, store
from quillon.sources import symbols as source
from quillon.streaming import overlay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = """
with c as (select doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/' || cast(doc_id as varchar) || '.txt' as rel_path, text,
  cast(octet_length(encode(text)) as bigint) as size_bytes from documents)
"""
COUNT = """, n as (select rel_path, size_bytes, cast((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 as bigint) as matches from c),
m as (select * from n where matches > 0)
"""
TERM = "tion"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _counts(spark, sf, term=TERM, **options):
    return search.occurrence_counts(corpus.of_documents(spark, sf), request(term, kind=options.pop("kind", "literal"), **options))


@query(DOCS + COUNT + "select rel_path, matches from m")
def count_by_file(spark, sf):
    return search.count_by_file(_counts(spark, sf))


@query(DOCS + COUNT + "select least(cast(sum(matches) as bigint), 1000) as total, sum(matches) <= 1000 as exact from m")
def bounded_count(spark, sf):
    return search.bounded_count(_counts(spark, sf), 1000)


@query(DOCS + COUNT + "select cast(sum(matches) as bigint) as total, count(*) as files from m")
def probe(spark, sf):
    return search.probe(_counts(spark, sf))


@query(DOCS + COUNT + "select cast(least(1, count(*)) as integer) as found from m")
def exists(spark, sf):
    return search.exists(corpus.of_documents(spark, sf), request(TERM, kind="literal"))


@query(DOCS + COUNT + "select rel_path, matches from m order by matches desc, rel_path limit 20")
def top_files(spark, sf):
    return search.count_by_file(_counts(spark, sf)).limit(20)


@query(DOCS + COUNT + "select rel_path from m")
def files(spark, sf):
    return _counts(spark, sf).select("rel_path").orderBy("rel_path")


LINES = """, l as (select rel_path, size_bytes, cast(u.i - 1 as integer) as line, string_split(text, chr(10))[u.i] as body from c, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i))
"""
PLACES = LINES + """, p as (select *, string_split(lower(body), 'license') as parts from l where contains(lower(body), 'license')),
q as (select rel_path, size_bytes, line, body, cast(list_sum(list_transform(parts[1:v.k], lambda x: length(x))) + (v.k - 1) * 7 as integer) as start_column from p, unnest(range(1, len(parts))) as v(k))
"""


@query(DOCS + PLACES + "select rel_path, line, start_column, start_column + 7 as end_column from q")
def literal_lines(spark, sf):
    return search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal")).select("rel_path", "line", "start_column", "end_column")


@query(DOCS + PLACES + "select rel_path, line, start_column, case when length(body) <= 240 then body else case when start_column > 116 then '…' else '' end || substr(body, greatest(start_column - 116, 0) + 1, 240) || case when greatest(start_column - 116, 0) + 240 < length(body) then '…' else '' end end as preview from q order by rel_path, line, start_column limit 1")
def first_match(spark, sf):
    rows = search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal"))
    return rows.orderBy("rel_path", "line", "start_column").limit(1).select("rel_path", "line", "start_column", "preview")


RANKED = """, s as (select *, cast(100 * count(*) over (partition by rel_path) - 3 * (length(rel_path) - length(replace(rel_path, '/', ''))) - octet_length(encode(rel_path)) as bigint) as score from q)
"""


@query(DOCS + PLACES + RANKED + "select rel_path, score, line, start_column, left(body, 240) as preview from s where length(body) <= 240 order by score desc, rel_path, line, start_column limit 25")
def search_page(spark, sf):
    """The first page of matches in lines short enough to be shown whole."""
    rows = search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal"))
    ranked = search.ranked(rows).where(F.length("preview") <= 240)
    return search.in_order(ranked).limit(25).select("rel_path", "score", "line", "start_column", "preview")


@query(DOCS + PLACES + RANKED + "select rel_path, score, line, start_column from s order by score desc, rel_path, line, start_column limit 25 offset 5")
def search_ranked(spark, sf):
    rows = search.match_positions(corpus.of_documents(spark, sf), request("license", kind="literal"))
    return search.page(rows, 25, 5).select("rel_path", "score", "line", "start_column")


@query(DOCS + LINES + "select rel_path, line, cast(count(*) as bigint) as n from (select rel_path, line, unnest(regexp_extract_all(body, '(?i)th[aeiou]nd?ing')) from l) group by 1, 2")
def regex_lines(spark, sf):
    rows = search.match_positions(corpus.of_documents(spark, sf), request("th[aeiou]nd?ing", kind="regex"))
    return rows.groupBy("rel_path", "line").agg(F.count(F.lit(1)).alias("n"))


@query(DOCS + "select rel_path, cast(len(regexp_extract_all(text, '(?s)nd\\.\\n[A-Z]')) as bigint) as matches from c where regexp_matches(text, '(?s)nd\\.\\n[A-Z]')")
def regex_multiline(spark, sf):
    return _counts(spark, sf, r"nd\.\n[A-Z]", kind="regex", multiline=True, case="sensitive").select("rel_path", "matches")


@query(DOCS + r", n as (select rel_path, cast(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t = 'the')) as bigint) as matches from c) select * from n where matches > 0")
def whole_word(spark, sf):
    return _counts(spark, sf, "the", whole_word=True).select("rel_path", "matches")


@query(DOCS + "select rel_path from c where contains(lower(text), 'apache license') or contains(lower(text), 'mit license')")
def or_terms(spark, sf):
    return _counts(spark, sf, "apache license", queries=["mit license"]).select("rel_path")


@query(DOCS + "select rel_path from c where rel_path like 'src1/%' and not rel_path like '%/fr/%' and contains(text, 'ing')")
def path_scope(spark, sf):
    scope = globs.Scope.parse(["src1/", "!fr/"])
    return _counts(spark, sf, "ing", case="sensitive", scope=scope).select("rel_path")


@query(DOCS + "select rel_path from c where regexp_matches(rel_path, '7/(en|de)/\\d+5') and contains(text, 'er')")
def path_regex(spark, sf):
    return _counts(spark, sf, r"file:7/(en|de)/\d+5 er", kind="auto", case="sensitive").select("rel_path")


@query("select regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as rel_path, cast((length(html) - length(replace(html, '<p>', ''))) / 3 as bigint) as matches from pages where contains(html, '<p>')")
def page_matches(spark, sf):
    return search.occurrence_counts(corpus.of_pages(spark, sf), request("<p>", kind="literal", case="sensitive")).select("rel_path", "matches")


@query(DOCS + COUNT + "select rel_path, cast(100 * matches - 3 * (length(rel_path) - length(replace(rel_path, '/', ''))) - octet_length(encode(rel_path)) as bigint) as score from m")
def rank_files(spark, sf):
    return _counts(spark, sf).select("rel_path", search.score(F.col("matches"), F.col("rel_path")).alias("score")).orderBy(F.desc("score"), "rel_path")


@query(DOCS + r"""select rel_path, regexp_replace(text, '(?i)\b([\w.-]*(?:password|passwd|secret|token|credential|api[_-]?key|private[_-]?key)[\w.-]*\s*[:=]\s*)("[^"\n]*"|''[^''\n]*''|["''`]?[^\s"''`]+)', '\1[REDACTED]', 'g') as text from c""")
def redact(spark, sf):
    return corpus.of_documents(spark, sf).select("rel_path", search.redact(F.col("rel_path"), F.col("text")).alias("text"))


GRAMS = DOCS + r"""
, t as (select doc_id, unnest(list_distinct(list_concat(regexp_split_to_array(lower(rel_path), '[^\p{L}\p{N}_]+'), regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')))) as t from c),
g as (select distinct doc_id, substr(t, i.i, w.w) as gram from t, (values (2), (3), (4)) as w(w), unnest(range(1, length(t) - w.w + 2)) as i(i))
"""


def _index(spark, sf):
    """(docs, postings) of the written index over the documents."""
    return corpus.read_index(spark, corpus.index_of_documents(spark, sf))


def _blocks(spark, sf):
    return corpus.read_blocks(spark, corpus.index_of_documents(spark, sf))


@query(GRAMS + "select c.doc_id, size_bytes as byte_len, count(g.gram) as grams, false as gram_incomplete from c left join g using (doc_id) group by 1, 2")
def index_docs(spark, sf):
    return _index(spark, sf)[0].select("doc_id", "byte_len", F.col("gram_count").alias("grams"), "gram_incomplete")


@query(GRAMS + "select length(gram) as width, count(*) as pairs, count(distinct gram) as grams from g group by 1")
def doc_grams(spark, sf):
    return _blocks(spark, sf).groupBy(F.length("gram").cast("long").alias("width")).agg(F.sum("n").alias("pairs"), F.countDistinct("gram").alias("grams"))


@query(GRAMS + "select gram, count(*) as df from g group by 1")
def gram_df(spark, sf):
    return _blocks(spark, sf).groupBy("gram").agg(F.sum("n").alias("df"))


@query(GRAMS + "select gram, cast(list(doc_id order by doc_id) as varchar) as docs from g where gram in ('lice', 'apac', 'mit') group by 1")
def postings(spark, sf):
    rows = _index(spark, sf)[1].where(F.col("gram").isin("lice", "apac", "mit"))
    docs = F.sort_array(F.collect_set("doc_id"))
    return rows.groupBy("gram").agg(F.concat(F.lit("["), F.array_join(docs.cast("array<string>"), ", "), F.lit("]")).alias("docs"))


@query(DOCS + "select cast(count(*) as bigint) as docs, cast(sum(size_bytes) as bigint) as bytes from c")
def index_build(spark, sf):
    """Writes an index of the documents anew, and reads its manifest."""
    path = store.new_path(spark, "index")
    corpus.write_index(corpus.of_documents(spark, sf), path)
    return spark.read.parquet(f"{path}/manifest").select("docs", "bytes")


@query(DOCS + "select cast(count(*) as bigint) as docs, cast(sum(size_bytes) as bigint) as bytes, cast(0 as bigint) as generation, 2 as schema_version from c")
def index_manifest(spark, sf):
    return spark.read.parquet(corpus.index_of_documents(spark, sf) + "/manifest").select("docs", "bytes", "generation", "schema_version")


@query(DOCS + "select count(*) as files, count(distinct text) as contents from c where text in (select text from c group by 1 having count(*) > 1)")
def content_duplicates(spark, sf):
    """Files that another one equals, told by the content hash of the index."""
    docs = _index(spark, sf)[0].where("byte_len is not null")
    many = docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count(F.lit(1)).alias("contents"))


@query(DOCS + r"""
, t as (select distinct doc_id, case when length(t) <= 4 then 'short' when length(t) <= 8 then 'medium' else 'long' end as class, t from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) as t from c) where t <> '')
select class, count(*) as n from t group by 1""")
def token_classes(spark, sf):
    t = corpus.of_documents(spark, sf).select("doc_id", F.explode(F.array_distinct(grams.tokens(F.col("text")))).alias("t"))
    return t.groupBy(grams.token_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _pruned(spark, sf, term, **options):
    r = request(term, **options)
    docs, posts = _index(spark, sf)
    return search.occurrence_counts(search.pruned(corpus.of_documents(spark, sf), docs, posts, r), r), r


def _sets(r):
    from quillon.plans.query import plan

    return " or ".join("doc_id in (select doc_id from g where gram in (" + ", ".join(f"'{x}'" for x in sorted(s)) + f") group by doc_id having count(*) = {len(s)})" for s in plan(r))


def _grams_of(term):
    from quillon.plans.query import plan

    return set().union(*plan(request(term, kind="literal")))


@query(GRAMS + "select doc_id from c where " + _sets(request("apache license", kind="literal")))
def candidates_and(spark, sf):
    return search.candidates(*_index(spark, sf), request("apache license", kind="literal"))


@query(GRAMS + "select doc_id from c where " + _sets(request("(?:apache|mit) +licen[cs]e", kind="regex")))
def candidates_or(spark, sf):
    return search.candidates(*_index(spark, sf), request("(?:apache|mit) +licen[cs]e", kind="regex"))


@query(DOCS + "select rel_path, cast((length(lower(text)) - length(replace(lower(text), 'apache license', ''))) / 14 as bigint) as matches from c where contains(lower(text), 'apache license')")
def search_pruned(spark, sf):
    return _pruned(spark, sf, "apache license", kind="literal")[0].select("rel_path", "matches")


@query(DOCS + ", g as (select distinct doc_id, substr(lower(text), i.i, 3) as gram from c, unnest(range(1, length(text) - 1)) as i(i)) select doc_id from g where gram in ('mit', 'it ', 't l', ' li', 'lic') group by 1 having count(*) = 5")
def trigram_candidates(spark, sf):
    return search.trigram_candidates(search.trigram_postings(corpus.of_documents(spark, sf)), "mit lic")


@query(GRAMS + ", w(gram) as (values " + ", ".join(f"('{x}')" for x in sorted(_grams_of("apache license"))) + "), k as (select count(*) as n from c where " + _sets(request("apache license", kind="literal")) + ") select w.gram, count(g.doc_id) as df, any_value(k.n) as candidates from w left join g using (gram), k group by 1")
def explain_counts(spark, sf):
    return search.explain(*_index(spark, sf), request("apache license", kind="literal"))


FEED = """
with f as (select 'user/' || cast(user_id as varchar) as rel_path, event_id as generation, case event_type when 'error' then true else false end as tombstone, event_type || ':' || coalesce(props, '') as text from events),
o as (select *, row_number() over (partition by rel_path order by generation desc) as k from f)
"""


def _feed(spark, sf):
    e = _table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("modify")
    changes = e.select(kind.alias("kind"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("rel_path"), F.lit(None).cast("string").alias("new_rel_path"), F.col("event_id").alias("generation"), F.lit(0).cast("long").alias("seq"))
    texts = e.select(F.col("event_id").alias("generation"), F.concat(F.col("event_type"), F.lit(":"), F.coalesce("props", F.lit(""))).alias("text"))
    return overlay.apply_batch(changes).join(texts, "generation")


@query(FEED + "select rel_path, generation, tombstone from o where k = 1")
def overlay_latest(spark, sf):
    return overlay.latest(_feed(spark, sf)).select("rel_path", "generation", "tombstone")


@query(FEED + "select count(*) filter (not tombstone) as live, count(*) filter (tombstone) as tombstones, count(*) filter (not tombstone and k = 1) as latest_live, count(*) filter (tombstone and k = 1) as latest_tombstones from o")
def overlay_stats(spark, sf):
    return overlay.stats(_feed(spark, sf))


BASE = ", b as (select 'user/' || cast(c_custkey as varchar) as rel_path, 'purchase:' || c_name as text from customer), v as (select * from b where rel_path not in (select rel_path from o) union all select rel_path, text from o where k = 1 and not tombstone)"


def _merged(spark, sf):
    base = _table(spark, sf, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("rel_path"), F.concat(F.lit("purchase:"), "c_name").alias("text"))
    return overlay.merged(base, _feed(spark, sf))


@query(FEED + BASE + "select rel_path, cast(1 as bigint) as matches from v where contains(text, 'purchase:')")
def overlay_search(spark, sf):
    rows = _merged(spark, sf).withColumn("size_bytes", F.octet_length("text"))
    return search.occurrence_counts(rows, request("purchase:", kind="literal", case="sensitive")).select("rel_path", "matches")


@query(FEED + BASE + "select rel_path, text from v")
def compacted_corpus(spark, sf):
    return _merged(spark, sf)


SYMBOLS = """
with y as (select 'part:' || cast(p_partkey as varchar) as id, p_name as name, p_brand || '.' || p_name as qualified_name, case p_size % 3 when 0 then 'class' when 1 then 'method' else 'function' end as kind,
  p_type as language, p_brand as rel_path, cast(p_partkey as integer) as start_line, 0 as start_column, cast(p_partkey + p_size as integer) as end_line, case when p_size % 2 = 0 then p_brand end as container_name, p_partkey as symbol_ord from part),
r as (select 'part:' || cast(l_partkey as varchar) as target_symbol_id, case l_returnflag when 'A' then 'usage' when 'N' then 'call' else 'construct' end as edge_kind, 'order/' || cast(l_orderkey % 97 as varchar) as rel_path,
  cast(l_orderkey as integer) as line, l_linenumber as "column", case when l_linenumber > 1 then 'order:' || cast(l_orderkey as varchar) end as enclosing_symbol_id from lineitem)
"""


def _symbols(spark, sf):
    p = _table(spark, sf, "part")
    text = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "method").otherwise("function")
    return p.select(
        F.concat(F.lit("part:"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), kind.alias("kind"), F.col("p_type").alias("language"),
        F.col("p_brand").alias("rel_path"), F.col("p_partkey").cast("int").alias("start_line"), F.lit(0).alias("start_column"), (F.col("p_partkey") + F.col("p_size")).cast("int").alias("end_line"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("container_name"), F.col("p_partkey").alias("symbol_ord"),
    )


def _refs(spark, sf):
    i = _table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "usage").when(F.col("l_returnflag") == "N", "call").otherwise("construct")
    order = F.col("l_orderkey").cast("string")
    return i.select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_symbol_id"), kind.alias("edge_kind"), F.concat(F.lit("order/"), (F.col("l_orderkey") % 97).cast("string")).alias("rel_path"),
        F.col("l_orderkey").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("column"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("order:"), order)).alias("enclosing_symbol_id"),
    )


@query(SYMBOLS + """, s as (select *, case when id = 'red' then 10000 when qualified_name = 'red' then 9000 when name = 'red' then 8000 when lower(qualified_name) = 'red' then 7500 when lower(name) = 'red' then 7000
  when contains(lower(name), 'red') then 5000 - length(name) when contains(lower(qualified_name), 'red') then 4500 - length(qualified_name) when contains(lower(rel_path), 'red') then 2000 else 0 end as score from y)
select id, cast(score as integer) as score from s where score > 0 order by score desc, qualified_name, rel_path, start_line limit 50""")
def symbol_search(spark, sf):
    return graph.search_symbols(_symbols(spark, sf), "red", 50).select("id", "score")


@query(SYMBOLS + "select 'prefix' as mode, count(*) as n from y where starts_with(lower(name), 'b') or starts_with(lower(qualified_name), 'b') union all select 'substring', count(*) from y where contains(lower(name), 'e') or contains(lower(qualified_name), 'e') union all select 'container', count(*) from y where container_name = 'Brand#13'")
def symbol_modes(spark, sf):
    s = _symbols(spark, sf)
    n = lambda mode, c: s.where(c).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
    return n("prefix", graph.match_mode("b", "prefix")).unionAll(n("substring", graph.match_mode("e", "substring"))).unionAll(n("container", graph.in_container("Brand#13")))


@query(SYMBOLS + "select id, start_line from y where rel_path = 'Brand#13' and start_line >= 10 and start_line < 1000")
def document_symbols(spark, sf):
    return graph.document_symbols(_symbols(spark, sf), "Brand#13", 10, 1000).select("id", "start_line")


@query(SYMBOLS + 'select rel_path, line, "column", count(*) over () as total from r where target_symbol_id = \'part:7\' order by rel_path, line, "column" limit 20')
def usages(spark, sf):
    return graph.usages(_refs(spark, sf), "part:7", 20).select("rel_path", "line", "column", "total")


@query(SYMBOLS + "select id, count(r.target_symbol_id) as usage_count from y left join r on id = target_symbol_id group by 1")
def usage_counts(spark, sf):
    return graph.usage_counts(_symbols(spark, sf), _refs(spark, sf))


@query(SYMBOLS + 'select target_symbol_id, edge_kind, "column" from r where enclosing_symbol_id = \'order:7\'')
def callees(spark, sf):
    return graph.callees(_refs(spark, sf), "order:7").select("target_symbol_id", "edge_kind", "column")


@query(SYMBOLS + "select coalesce(enclosing_symbol_id, rel_path) as caller, count(*) as n from r where target_symbol_id = 'part:11' group by 1")
def callers_summary(spark, sf):
    return graph.callers_summary(_refs(spark, sf), "part:11")


@query(SYMBOLS + "select 'kind:' || edge_kind as key, count(*) as n, count(distinct rel_path) as files from r group by 1 union all select rel_path, count(*), count(distinct rel_path) from r group by 1")
def group_references(spark, sf):
    r = _refs(spark, sf)
    return graph.group_references(r, "edge_kind").withColumn("key", F.concat(F.lit("kind:"), "key")).unionByName(graph.group_references(r, "file"))


HIERARCHY = """
with recursive h(child, parent) as (select 'n' || cast(n_nationkey as varchar), 'r' || cast(n_regionkey as varchar) from nation union all select 'c' || cast(c_custkey as varchar), 'n' || cast(c_nationkey as varchar) from customer
  union all select 's' || cast(s_suppkey as varchar), 'n' || cast(s_nationkey as varchar) from supplier),
d(ancestor, descendant) as (select parent, child from h union select d.ancestor, h.child from d join h on d.descendant = h.parent)
"""


def _hierarchy(spark, sf):
    link = lambda t, p, k, q, j: _table(spark, sf, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("child"), F.concat(F.lit(q), F.col(j).cast("string")).alias("parent"))
    return link("nation", "n", "n_nationkey", "r", "n_regionkey").unionAll(link("customer", "c", "c_custkey", "n", "c_nationkey")).unionAll(link("supplier", "s", "s_suppkey", "n", "s_nationkey"))


@query(HIERARCHY + "select ancestor, descendant from d")
def descendants(spark, sf):
    return graph.descendants(_hierarchy(spark, sf))


@query(HIERARCHY + ", a as (select ancestor, count(*) as n from d group by 1) select ancestor as id, n as implementations from a")
def implementation_counts(spark, sf):
    return graph.descendants(_hierarchy(spark, sf)).groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("implementations"))


@query(HIERARCHY + ", m as (select c_custkey as k, 'c' || cast(c_custkey as varchar) as owner, c_nationkey % 5 as name from customer union all select 1000000 + n_nationkey, 'n' || cast(n_nationkey as varchar), n_nationkey % 5 from nation) select cast(a.k as varchar) as id, count(*) as n from m a join d on d.ancestor = a.owner join m b on b.owner = d.descendant and b.name = a.name group by 1")
def member_implementations(spark, sf):
    c = _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("container_id"), (F.col("c_nationkey") % 5).cast("string").alias("name"))
    n = _table(spark, sf, "nation").select((F.col("n_nationkey") + 1000000).cast("string").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("container_id"), (F.col("n_nationkey") % 5).cast("string").alias("name"))
    members = c.unionByName(n).withColumn("kind", F.lit("method"))
    return graph.member_implementations(members, graph.descendants(_hierarchy(spark, sf))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(SYMBOLS + "select target_symbol_id, count(distinct case when edge_kind = 'call' then (rel_path, line, \"column\") end) as callers, count(distinct (rel_path, line, \"column\")) as usages, count(distinct enclosing_symbol_id) as enclosing from r group by 1")
def relation_summary(spark, sf):
    return graph.relation_summary(_refs(spark, sf))


@query(SYMBOLS + """, q as (select l_orderkey * 10 + l_linenumber as ref_id, p_name as name, case when l_orderkey % 3 = 0 then p_brand else 'elsewhere' end as rel_path, cast(case when l_orderkey % 5 = 0 then l_partkey else 0 end as integer) as line from lineitem join part on l_partkey = p_partkey),
f as (select rel_path, name, count(*) as n from y group by 1, 2), a as (select name, count(*) as n, min(id) as id from y group by 1),
e as (select rel_path, name, id, start_line, row_number() over (partition by rel_path, name order by symbol_ord) as k from y),
t as (select q.ref_id, f.n is not null as own, (select e.id from e where e.rel_path = q.rel_path and e.name = q.name and e.start_line <> q.line order by e.k limit 1) as o, a.n as n_all, a.id as g from q left join f on f.rel_path = q.rel_path and f.name = q.name left join a on a.name = q.name)
select ref_id, case when own then o when n_all = 1 then g end as target_symbol_id, case when own then 1 when n_all > 0 then 3 end as tier from t""")
def resolve_tiers(spark, sf):
    i = _table(spark, sf, "lineitem").join(_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("p_name").alias("name"), F.when(F.col("l_orderkey") % 3 == 0, F.col("p_brand")).otherwise("elsewhere").alias("rel_path"),
        F.when(F.col("l_orderkey") % 5 == 0, F.col("l_partkey")).otherwise(0).cast("int").alias("line"), F.lit(0).alias("column"),
    )
    return graph.resolve(refs, _symbols(spark, sf))


@query("""with recursive e as (select 'o' || cast(l_orderkey as varchar) as src, 'p' || cast(l_partkey as varchar) as dst from lineitem), s as (select src as node, dst as next from e union select dst, src from e),
a as (select distinct next as node, 1 as distance from s where node = 'p7'), b as (select distinct s.next as node, 2 as distance from a join s on a.node = s.node)
select node, min(distance) as distance from (select 'p7' as node, 0 as distance union all select * from a union all select * from b) group by 1 order by 2, 1 limit 200""")
def neighbours_depth2(spark, sf):
    e = _table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("call").alias("edge_kind"))
    return graph.neighbours(e, "p7", 2, most=200)


@query(SYMBOLS + ", f as (select distinct rel_path from y where container_name is null order by rel_path limit 5), k as (select *, row_number() over (partition by rel_path order by start_line, start_column, id) as place from y where container_name is null and rel_path in (from f)) select rel_path, id, name, cast(place as integer) as place from k where place <= 10")
def outline_caps(spark, sf):
    return graph.outline(_symbols(spark, sf), 5, 10)


@query(SYMBOLS + "select language, kind, count(*) as n from y group by 1, 2")
def graph_info(spark, sf):
    return graph.graph_info(_symbols(spark, sf))


@query(DOCS + "select rel_path, 'text' as language, cast(len(string_split(text, chr(10))) as integer) as lines, size_bytes as bytes from c where text is not null")
def file_digest(spark, sf):
    return search.file_digest(corpus.of_documents(spark, sf).where("text is not null")).select("rel_path", "language", "lines", "bytes")


@query("""with l as (select 'f' || cast(l_partkey % 50 as varchar) as rel_path, l_orderkey % 5000 as s, l_orderkey % 5000 + l_linenumber as e from lineitem),
n as (select *, case when s > max(e) over (partition by rel_path order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from l),
i as (select *, sum(new) over (partition by rel_path order by s, e rows between unbounded preceding and current row) as island from n)
select rel_path, cast(min(s) as integer) as start_line, cast(max(e) as integer) as end_line from i group by rel_path, island""")
def snippet_merge(spark, sf):
    start = F.col("l_orderkey") % 5000
    rows = _table(spark, sf, "lineitem").select(F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("rel_path"), start.cast("int").alias("start_line"), (start + F.col("l_linenumber")).cast("int").alias("end_line"))
    return search.merge_snippets(rows)


@query(SYMBOLS + """, q as (select o_orderkey as place_id, 'Brand#' || cast(11 + o_custkey % 45 as varchar) as rel_path, o_orderkey % 2000 as line from orders),
m as (select q.place_id, y.id, row_number() over (partition by q.place_id order by y.end_line - y.start_line, y.start_line, y.id) as k from q join y on y.rel_path = q.rel_path and q.line between y.start_line and y.end_line)
select q.place_id, m.id as symbol_id from q left join m on m.place_id = q.place_id and m.k = 1""")
def enclosing_symbol(spark, sf):
    places = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("place_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 45 + 11).cast("string")).alias("rel_path"), (F.col("o_orderkey") % 2000).alias("line"))
    return graph.enclosing(_symbols(spark, sf), places)


@query(DOCS + "select count(*) as overlap, cast(0 as bigint) as missing, cast(0 as bigint) as extra, cast(1.0 as double) as recall, cast(1.0 as double) as precision from c where contains(lower(text), 'apache license')")
def search_quality(spark, sf):
    found, r = _pruned(spark, sf, "apache license", kind="literal")
    return search.quality(found, search.occurrence_counts(corpus.of_documents(spark, sf), r))


@query("select o_orderpriority, list(o_totalprice order by o_totalprice)[cast(ceil(0.95 * (count(*) - 1)) as integer) + 1] as p95 from orders group by 1")
def percentile_rank(spark, sf):
    return search.nearest_rank(_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 0.95).withColumnRenamed("value", "p95")


@query(DOCS + "select coalesce(split_part(rel_path, '/', 2), '') as language, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from c group by 1")
def language_counts(spark, sf):
    return corpus.of_documents(spark, sf).groupBy(F.split_part("rel_path", F.lit("/"), F.lit(2)).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query("""select coalesce(source, 'unknown') as source, count(*) as n, count(distinct text) as texts from documents group by 1""")
def distinct_contents(spark, sf):
    return _table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


SOURCES = """
with n as (select n_nationkey as k, 'nation' || cast(n_nationkey as varchar) || '/base.py' as rel_path from nation),
s as (select s_suppkey as k, s_nationkey as n, 'nation' || cast(s_nationkey as varchar) || '/s' || cast(s_suppkey as varchar) || '.py' as rel_path from supplier),
y as (select rel_path, 'Nation_' || cast(k as varchar) as qualified_name, 'class' as kind, 0 as start_line, 2 as end_line from n union all select rel_path, 'Nation_' || cast(k as varchar) || '.describe', 'method', 1, 2 from n
  union all select rel_path, 'Supplier_' || cast(k as varchar) || v.suffix, v.kind, v.a, v.b from s, (values ('', 'class', 2, 7), ('.__init__', 'constructor', 3, 4), ('.size', 'constant', 4, 4), ('.run', 'method', 6, 7)) as v(suffix, kind, a, b))
"""


def _source_texts(spark, sf):
    """A small Python package for each nation: a base class, and a class for each supplier that extends it."""
    n = _table(spark, sf, "nation").select(F.format_string("nation%d/base.py", "n_nationkey").alias("rel_path"), F.format_string("class Nation_%d:\n    def describe(self):\n        return %d\n", "n_nationkey", "n_nationkey").alias("text"))
    body = "from .base import Nation_%d\n\nclass Supplier_%d(Nation_%d):\n    def __init__(self):\n        self.size = %d\n\n    def run(self):\n        return self.describe()\n"
    s = _table(spark, sf, "supplier").select(F.format_string("nation%d/s%d.py", "s_nationkey", "s_suppkey").alias("rel_path"), F.format_string(body, "s_nationkey", "s_suppkey", "s_nationkey", "s_suppkey").alias("text"))
    return n.unionAll(s)


def _sources(spark, sf):
    return store.keep(source.extracts(_source_texts(spark, sf)))


@query(SOURCES + "select rel_path, qualified_name, kind, start_line, end_line from y")
def source_symbols(spark, sf):
    return build.symbols(_sources(spark, sf)).select("rel_path", "qualified_name", "kind", "start_line", "end_line")


@query(SOURCES + "select rel_path, 'Nation_' || cast(n as varchar) as local_name, 'nation' || cast(n as varchar) || '/base.py' as target_rel_path from s")
def source_imports(spark, sf):
    return build.imports(_sources(spark, sf)).select("rel_path", "local_name", "target_rel_path")


@query(SOURCES + """, t as (select *, 'python:nation' || cast(n as varchar) || '/base.py:Nation_' || cast(n as varchar) as base from s)
select base || ':1' as target_symbol_id, 'usage' as edge_kind, rel_path, 0 as line, 18 as "column" from t
union all select base || ':1', 'usage', rel_path, 2, cast(16 + length(cast(k as varchar)) as integer) from t
union all select base || '.describe:2', 'call', rel_path, 7, 20 from t""")
def source_references(spark, sf):
    parts = _sources(spark, sf)
    s = store.keep(build.symbols(parts))
    return build.references(parts, s, graph.descendants(graph.parents(s))).select("target_symbol_id", "edge_kind", "rel_path", "line", "column")


@query(SOURCES + "select 'Nation_' || cast(n as varchar) as ancestor, count(*) as implementations from s group by 1")
def source_implementations(spark, sf):
    s = store.keep(build.symbols(_sources(spark, sf)))
    return graph.descendants(graph.parents(s)).join(s.select(F.col("id").alias("ancestor"), "name"), "ancestor").groupBy(F.col("name").alias("ancestor")).agg(F.count(F.lit(1)).alias("implementations"))



@query(SOURCES + "select rel_path, qualified_name from y where qualified_name not like '%.%'")
def source_exports(spark, sf):
    return build.exported(build.symbols(_sources(spark, sf))).select("rel_path", "qualified_name")
