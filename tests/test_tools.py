"""Every named request on a small workspace."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import build
from quillon.plans import tools
from quillon.sources import corpus
from tests.test_symbols import FILES


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tools"))
    rows = spark.createDataFrame([(i, p, t, len(t or "")) for i, (p, t) in enumerate(FILES.items())], "doc_id long, rel_path string, text string, size_bytes long").cache()
    corpus.write_index(rows, f"{path}/index")
    docs, postings = corpus.read_index(spark, f"{path}/index")
    build.write_graph(rows, f"{path}/graph")
    return tools.Workspace(rows, docs, postings, build.read_graph(spark, f"{path}/graph"))


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_searches(work):
    assert set(values(work.call("files", query="class Base"), "rel_path")) == {"app/base.py"}
    assert values(work.call("search_code", query="class Base", limit=5), "rel_path", "line", "start_column") == [("app/base.py", 0, 0)]
    assert values(work.call("top_files", query="svc", case="insensitive", limit=1), "rel_path") == ["web/a.ts"]
    assert values(work.call("probe", query="getattr"), "total", "files") == [(1, 1)]
    assert values(work.call("exists", query="absent thing"), "found") == [0] and values(work.call("exists", query="getattr"), "found") == [1]
    assert values(work.call("first", query="shared"), "rel_path") == ["web/a.ts"]
    assert values(work.call("count", query="getattr", scope="web/"), "rel_path") == []
    assert values(work.call("bounded_count", query="return", most=2), "total", "exact") == [(2, False)]
    assert values(work.call("test", query="shared"), "recall", "precision") == [(1.0, 1.0)]
    assert work.call("explain_search_query", query="shared").count() > 0
    assert values(work.call("read_snippets", ranges=[("app/dep.py", 0, 0), ("app/dep.py", 1, 1)]), "snippet") == ["class Dep:\n    def work(self) -> int:"]
    assert work.call_json("files", query="getattr").first()[0] == '{"rel_path":"app/util.py"}'


def test_graph_requests(work):
    ids = {r["qualified_name"]: r["id"] for r in work.table("symbols").collect() if r["rel_path"].startswith("app/")}
    assert values(work.call("find_implementations", symbol_id=ids["Base"]), "name") in (["Child"], ["Child", "Kt"])
    assert values(work.call("callers_summary", symbol_id=ids["Base.run"]), "caller") == [ids["Child.go"]]
    assert [x.split(":")[2] for x in values(work.call("get_callees", symbol_id=ids["Child.go"]), "target_symbol_id")][:2] == ["Base.run", "Child.dep"]
    assert values(work.call("symbol_slice", symbol_id=ids["Dep"]), "snippet") == ["class Dep:\n    def work(self) -> int:\n        return 1 // 2"]
    assert values(work.call("signature", symbol_id=ids["Dep.work"]), "signature") == ["def work(self)"]
    assert values(work.call("resolve_at", path="app/child.py", line=12, column=18), "id") == [ids["Dep.work"]]
    assert values(work.call("resolve_at", path="app/child.py", line=9, column=9), "id") == [ids["Child.go"]]
    d = work.call("symbol_details", symbol_id=ids["Base"]).first()
    assert d["usages"] >= 2 and d["implementations"] >= 1
    near = dict(values(work.call("graph_neighbors", symbol_id=ids["Child"], depth=1, kinds=["implements"]), "node", "distance"))
    assert near == {ids["Child"]: 0, ids["Base"]: 1}
    assert values(work.call("search_symbols", query="go", languages=["python"]), "id")[0] == ids["Child.go"]
    assert values(work.call("search_symbols", query="J", framework="SpringBean"), "name") == ["J"]
    assert work.call("find_references", symbol_id=ids["Base"], group_by="file").count() >= 1
    assert {x for x in values(work.call("exports", path="web/a.ts"), "name")} == {"A"}
    assert work.call("context_bundle", query="Base.run").first()["bundle"].startswith("method Base.run\ncallers: Child.go")


def test_refresh_and_update(spark, tmp_path):
    """A refresh changes what later searches see, entry by entry; a graph update resolves unchanged files anew."""
    rows = spark.createDataFrame([(i, p, t, len(t)) for i, (p, t) in enumerate([("a.py", "class A:\n    def run(self):\n        return 1\n"), ("b.py", "from a import A\n\nclass B(A):\n    def go(self):\n        return self.run()\n"), ("c.py", "needle = 1\n")])], "doc_id long, rel_path string, text string, size_bytes long")
    corpus.write_index(rows, f"{tmp_path}/index")
    w = tools.Workspace(rows, *corpus.read_index(spark, f"{tmp_path}/index"))
    w.call("rebuild_graph", path=f"{tmp_path}/graph")
    schema = "kind string, rel_path string, new_rel_path string, generation long, seq long"
    assert set(values(w.call("files", query="needle"), "rel_path")) == {"c.py"}
    later = spark.createDataFrame([(0, "a.py", "needle in a", 11), (2, "c.py", "other", 5)], rows.schema)
    w.corpus = later
    w.call("refresh_index", changes=spark.createDataFrame([("modify", "a.py", None, 1, 0), ("modify", "c.py", None, 1, 1), ("delete", "b.py", None, 1, 2)], schema))
    w.corpus = rows
    assert set(values(w.call("files", query="needle"), "rel_path")) == {"a.py"} and values(w.call("files", query="import"), "rel_path") == []
    w.call("refresh_index", changes=spark.createDataFrame([("rename", "a.py", "c.py", 2, 0)], schema))
    assert set(values(w.call("files", query="needle"), "rel_path")) == {"c.py"}
    run = "python:a.py:A.run:2"
    assert values(w.call("find_references", symbol_id=run), "rel_path") == ["b.py"]
    assert w.call("graph_edges", symbol_id="python:a.py:A:1", kinds=["implements"]).count() == 1
    w.call("update_graph", changed=spark.createDataFrame([("a.py", "x = 1\n\nclass A:\n    def run(self):\n        return 1\n")], "rel_path string, text string"))
    assert values(w.call("find_references", symbol_id=run), "rel_path") == ["b.py"]  # moved, with its id
    w.call("update_graph", changed=spark.createDataFrame([("a.py", None)], "rel_path string, text string"))
    assert values(w.call("find_references", symbol_id=run), "rel_path") == [] and {x for x in values(w.table("symbols"), "rel_path")} == {"b.py", "c.py"}


def test_other_requests(work, spark, tmp_path):
    changes = spark.createDataFrame([("modify", "app/dep.py", None, 1, 0), ("delete", "gone.py", None, 1, 1)], "kind string, rel_path string, new_rel_path string, generation long, seq long")
    assert {x for x in values(work.call("changed", changes=changes), "rel_path", "name")} == {("app/dep.py", "Dep"), ("app/dep.py", "work"), ("gone.py", None)}
    assert {x for x in values(work.call("refresh_index", changes=changes), "rel_path", "tombstone")} == {("app/dep.py", False), ("gone.py", True)}
    for name, arguments in {"workspace_overview": {}, "index_status": {}, "health": {}, "file_digest": {}, "imports": {}, "outline": {}, "document_symbols": {"path": "app/dep.py"}, "graph_info": {}, "inlay_counts": {"path": "app/base.py"}}.items():
        assert work.call(name, **arguments).count() > 0, name
    for old, new in tools.ALIASES.items():
        assert new in tools.REQUESTS, old
    bare = tools.Workspace(work.corpus)
    for name, arguments in (("outline", {}), ("explain_search_query", {"query": "x"}), ("nothing", {})):
        with pytest.raises(ValueError):
            bare.call(name, **arguments)
    assert bare.call("rebuild_graph", path=str(tmp_path / "g")).agg(F.sum("n")).first()[0] == work.table("symbols").count()


LONG = "class Long:\n    def run(self):\n" + "        pass\n" * 399


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A base class with 1,100 subclasses, each in its own file, and a class of 401 lines."""
    rows = [("base.py", "class Base:\n    def run(self):\n        return 1\n"), ("long.py", LONG)] + [(f"s{k}.py", f"from base import Base\n\nclass Subclass_{k}(Base):\n    pass\n") for k in range(1100)]
    files = spark.createDataFrame([(i, p, t, len(t)) for i, (p, t) in enumerate(rows)], "doc_id long, rel_path string, text string, size_bytes long")
    path = str(tmp_path_factory.mktemp("wide"))
    build.write_graph(files, path)
    return tools.Workspace(files, graph=build.read_graph(spark, path))


def test_neighbors_are_all(wide):
    near = values(wide.call("graph_neighbors", symbol_id="python:base.py:Base:1", kinds=["implements"]), "node", "distance")
    assert near[0] == ("python:base.py:Base:1", 0) and {x for x, _ in near[1:]} == {f"python:s{k}.py:Subclass_{k}:3" for k in range(1100)} and len(near) == 1101
    assert wide.call("graph_neighbors", symbol_id="python:base.py:Base:1", kinds=["implements"], limit=7).collect() == [*wide.call("graph_neighbors", symbol_id="python:base.py:Base:1", kinds=["implements"]).take(7)]


def test_edges_are_all(wide):
    edges = values(wide.call("graph_edges", symbol_id="python:base.py:Base:1", kinds=["implements"]), "src", "dst", "edge_kind")
    assert sorted(edges) == sorted((f"python:s{k}.py:Subclass_{k}:3", "python:base.py:Base:1", "implements") for k in range(1100))
    assert wide.call("graph_edges", symbol_id="python:base.py:Base:1", kinds=["implements"], most_edges=7).count() == 7


def test_bundle_is_whole(wide):
    names = ", ".join(sorted(f"Subclass_{k}" for k in range(1100)))
    whole = f"class Base\ncallers: {names}\nclass Base:\n    def run(self):\n        return 1"
    assert len(names) > 12000 and values(wide.call("context_bundle", query="Base"), "bundle", "tokens") == [(whole, -(-len(whole) // 4))]
    assert values(wide.call("context_bundle", query="Base", most_chars=100), "bundle", "tokens") == [(whole[:100], 25)]
    assert values(wide.call("context_bundle", query="Long"), "bundle") == ["class Long\n" + LONG.rstrip("\n")]
