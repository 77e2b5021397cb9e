"""Symbols, imports and references from small sources in every language."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import lexer
from quillon.operators import build, graph
from quillon.sources import symbols as source

FILES = {
    "app/base.py": "class Base:\n    def run(self):\n        return 1\n\n    def stop(self):\n        pass\n",
    "app/child.py": "from .base import Base\nfrom . import util\n\nclass Child(Base):\n    LIMIT = 3\n\n    def __init__(self):\n        self.dep = Dep()\n\n    def go(self):\n        # stop in a comment\n        self.run()\n        self.dep.work()\n        util.helper()\n        return super().stop()\n",
    "app/dep.py": "class Dep:\n    def work(self) -> int:\n        return 1 // 2\n",
    "app/util.py": "def helper():\n    return getattr(Thing, 'x')\n",
    "web/a.ts": "import { shared as s } from './lib';\nimport * as ns from './lib';\nexport class A<T> extends B<T> implements I {\n  private n = 1;\n  handler = (e: Event) => { this.run(); };\n  constructor(private svc: Svc) { super(); }\n  run(): void {\n    const x = new Svc();\n    x.go(`a ${s(1)} go`);\n    ns.shared(2);\n  }\n}\nclass B<T> {}\ninterface I {}\n",
    "web/lib.ts": "export function shared(k) {\n  return k;\n}\nexport class Svc {\n  go(t: string) { return t }\n}\n",
    "s.graphql": "type Query { me: User }\ntype User { name: String friend: User }\nquery Q { me { friend { name } } }\n",
    "J.java": "@RestController\npublic class J extends K {\n  private int n = 1;\n  public J(int k) { n = k; }\n  @GetMapping(\"/x\")\n  public List<String> all(int k) throws E {\n    return null;\n  }\n}\n",
    "k.kt": "class Kt(val s: Svc) : Base(s), I {\n  val n = 1\n  fun run(x: Int): Int { return x }\n}\nfun top() = Kt()\n",
    "empty.py": "",
    "none.ts": None,
    "notes.md": "class Nothing: pass\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph"))
    build.write_graph(spark.createDataFrame(list(FILES.items()), "rel_path string, text string"), path)
    return build.read_graph(spark, path)


def test_code_has_the_length_of_its_text():
    for lang, text, left in (("python", "a = '#' # b\n\"\"\"c\n\"\"\" + d", "a + d ="), ("typescript", "a // b\n`c ${d} ${`e ${f}`}` + /\"/.g", "a d f + . g"), ("java", "'\"' + a /* b\n */ \"c", "+ a"), ("graphql", "a # b\n\"c\" d", "a d")):
        out = lexer.code(text, lang)
        assert len(out) == len(text) and out.count("\n") == text.count("\n") and set(out.split()) == set(left.replace(". g", ".g").split()), (lang, out)


def test_symbols(built):
    rows = {(r["rel_path"], r["qualified_name"]): r for r in built["symbols"].collect()}
    kinds = {k: r["kind"] for k, r in rows.items()}
    assert {k[1]: v for k, v in kinds.items() if k[0] == "app/child.py"} == {"Child": "class", "Child.LIMIT": "constant", "Child.__init__": "constructor", "Child.dep": "constant", "Child.go": "method"}
    assert {k[1]: v for k, v in kinds.items() if k[0] == "web/a.ts"} == {"A": "class", "A.n": "constant", "A.handler": "method", "A.constructor": "constructor", "A.run": "method", "B": "class", "I": "interface"}
    assert {k[1]: v for k, v in kinds.items() if k[0] == "J.java"} == {"J": "class", "J.n": "constant", "J.J": "constructor", "J.all": "method"}
    assert {k[1]: v for k, v in kinds.items() if k[0] == "k.kt"} == {"Kt": "class", "Kt.n": "constant", "Kt.run": "method", "top": "function"}
    assert kinds["s.graphql", "User.friend"] == "method" and kinds["s.graphql", "Q"] == "function"
    j = rows["J.java", "J.all"]
    assert j["markers"] == ["SpringRoute"] and (j["start_line"], j["end_line"]) == (5, 7) and rows["J.java", "J"]["markers"] == ["SpringBean"]
    a = rows["web/a.ts", "A"]
    assert (a["extends_names"], a["implements_names"], a["id"]) == (["B"], ["I"], "typescript:web/a.ts:A:3")
    assert rows["k.kt", "Kt"]["extends_names"] == ["Base", "I"]
    assert not any(p in ("empty.py", "none.ts", "notes.md") for p, _ in rows)


def test_imports(built):
    got = {(r["rel_path"], r["local_name"], r["imported_name"], r["target_rel_path"]) for r in build.imports(built["extracts"]).collect()}
    assert got == {("app/child.py", "Base", "Base", "app/base.py"), ("app/child.py", "util", None, "app/util.py"), ("web/a.ts", "s", "shared", "web/lib.ts"), ("web/a.ts", "ns", None, "web/lib.ts")}


def test_references(built):
    names = {r["id"]: r["rel_path"] + ":" + r["qualified_name"] for r in built["symbols"].collect()}
    got = {(names[r["target_symbol_id"]], r["edge_kind"], r["rel_path"], r["line"]) for r in built["refs"].collect()}
    want = {
        ("app/base.py:Base", "construct", "k.kt", 0),
        ("app/base.py:Base", "usage", "app/child.py", 0),
        ("app/base.py:Base", "usage", "app/child.py", 3),
        ("app/base.py:Base.run", "call", "app/child.py", 11),
        ("app/base.py:Base.stop", "call", "app/child.py", 14),
        ("app/dep.py:Dep", "construct", "app/child.py", 7),
        ("app/dep.py:Dep.work", "call", "app/child.py", 12),
        ("app/util.py:helper", "call", "app/child.py", 13),
        ("web/lib.ts:Svc.go", "call", "web/a.ts", 8),
        ("web/lib.ts:Svc", "construct", "web/a.ts", 7),
        ("web/lib.ts:shared", "call", "web/a.ts", 8),
        ("web/lib.ts:shared", "call", "web/a.ts", 9),
        ("web/a.ts:A.run", "call", "web/a.ts", 4),
        ("s.graphql:Query.me", "usage", "s.graphql", 2),
        ("s.graphql:User.friend", "usage", "s.graphql", 2),
        ("s.graphql:User.name", "usage", "s.graphql", 2),
    }
    assert want <= got, want - got
    assert not any(line == 10 for _, _, path, line in got if path == "app/child.py")


def test_calls(built):
    s = built["symbols"]
    bound = build.bindings(built["extracts"], s.where(F.col("kind").isin(*build.KINDS))).withColumnRenamed("scope_id", "enclosing_symbol_id")
    rows = graph.resolve_calls(build.call_sites(built["extracts"]), s, built["hierarchy"], bound).collect()
    got = {(r["enclosing_symbol_id"].split(":")[2], r["callee_id"].split(":")[2], r["confidence"]) for r in rows}
    assert {("Child.go", "Base.run", "resolved"), ("Child.go", "Base.stop", "resolved"), ("A.run", "Svc.go", "exact")} <= got


def test_odd_sources():
    for lang in source.LANGUAGES:
        for text in ("", "\n", "{", "}", "}}}{{{", "class", "class A", "class A {", "def f(", "@", "'", "`${", "/*", "(((", "query {", "type A {", "type A { b(", "import", "x" * 5000, "a." * 3000, "é = 1\n"):
            source.scan_file(f"f.{lang}", text, lang)
