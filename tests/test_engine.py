"""Engine operators on a small workspace, and pruned search against a full scan."""

import importlib
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.functions.globs import Scope
from quillon.operators import graph, search
from quillon.plans.query import request
from quillon.sources import corpus
from quillon.streaming import overlay

FILES = {
    "alpha.py": "class AlphaService:\n    def process(self):\n        return 1\n\nclass AlphaHelper:\n    pass\n",
    "beta.js": "class BetaWidget {}\nconst BETA_DEFAULT = 1;\n",
    "docs.md": "# 한국어 지원\nline one of the pull quote\nline two\nline three wraps up\n한국어지원 KÄSE\n",
    "nested/delta.js": "class DirectoryScopedThing {}\n",
}


@pytest.fixture(scope="module")
def work(spark):
    rows = [(i, p, t, len(t.encode())) for i, (p, t) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "doc_id long, rel_path string, text string, size_bytes long")


def found(work, *a, **k):
    return sorted((r["rel_path"], r["line"], r["start_column"], r["end_line"], r["end_column"]) for r in search.match_positions(work, request(*a, **k)).collect())


def test_positions(work):
    assert found(work, "class AlphaService:", kind="literal") == [("alpha.py", 0, 0, None, 19)]
    assert found(work, "quote\nline two", kind="literal") == [("docs.md", 1, 21, 2, 8)]
    assert found(work, "한국어", kind="literal", whole_word=True) == [("docs.md", 0, 2, None, 5)]
    assert found(work, "line one.*WRAPS UP", kind="regex", multiline=True, case="insensitive") == [("docs.md", 1, 0, 3, 19)]
    assert found(work, "line one.*WRAPS UP", kind="regex", case="insensitive") == []
    assert found(work, "BETA_DEFAULT", kind="literal") and found(work, "beta_default", kind="literal", case="sensitive") == []
    assert found(work, "käse", kind="literal") == [("docs.md", 4, 6, None, 10)]
    assert {r[0] for r in found(work, "class", kind="literal", scope=Scope.parse("!nested/"))} == {"alpha.py", "beta.js"}
    assert {r[0] for r in found(work, "class", kind="literal", scope=Scope.parse("nested/"))} == {"nested/delta.js"}


def test_pages_are_slices(work):
    rows = search.match_positions(work, request("l", kind="literal"))
    key = lambda df: [(r["rel_path"], r["line"], r["start_column"]) for r in df.collect()]
    whole = key(search.page(rows, 100))
    assert key(search.page(rows, 3)) + key(search.page(rows, 4, 3)) == whole[:7]
    assert len(key(search.early_page(rows, 2))) == 2


def test_pruned_is_scanned(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcsk ſABΟΔΣİé\n") for _ in range(60)) for _ in range(60)]
    table = spark.createDataFrame([(i, f"d/{i}.txt", t, len(t)) for i, t in enumerate(texts)], "doc_id long, rel_path string, text string, size_bytes long").cache()
    rows = corpus.index_rows(table).cache()
    docs, posts = corpus.index_docs(rows), corpus.postings(corpus.posting_blocks(rows)).cache()
    for kind, terms in (("literal", ["ab", "bca", "a b", "Ab", "sk", "ΟΣ", "ΔΟΣ", "οσ", "abΣ", "İa", "éa"]), ("regex", ["ab+c", "(?:a|abc)b", "a[bc]a", "ca(b|c)", "s+k", "ab{2}"])):
        for t in terms:
            r = request(t, kind=kind)
            a = {x["rel_path"] for x in search.occurrence_counts(search.pruned(table, docs, posts, r), r).collect()}
            b = {x["rel_path"] for x in search.occurrence_counts(table, r).collect()}
            assert a == b, t


def test_final_sigma(spark):
    """Lower case that hangs on the next letter: a word of the query may be the start of one in the text."""
    table = spark.createDataFrame([(1, "a.txt", "x ΟΔΟΣΑ y", 12)], "doc_id long, rel_path string, text string, size_bytes long")
    r = request("ΟΔΟΣ", kind="literal")
    rows = corpus.index_rows(table)
    assert search.occurrence_counts(table, r).count() == search.occurrence_counts(search.pruned(table, corpus.index_docs(rows), corpus.postings(corpus.posting_blocks(rows)), r), r).count() == 1


def test_many_matches(spark):
    """A hundred thousand matches in one file, in one line and in many; long lines show what is round the match."""
    for text in ("ab " * 100_000, "ab\n" * 100_000):
        table = spark.createDataFrame([("f", text, len(text))], "rel_path string, text string, size_bytes long")
        rows = search.match_positions(table, request("ab", kind="literal")).agg(F.count(F.lit(1)), F.max("line"), F.max("start_column"), F.max(F.length("preview"))).first()
        assert tuple(rows) == ((100_000, 0, 299_997, 242) if " " in text else (100_000, 99_999, 0, 2))
    line = "x" * 500 + "needle" + "y" * 500
    table = spark.createDataFrame([("f", f"one\r\n{line}\r\nneedle", 1)], "rel_path string, text string, size_bytes long")
    got = search.match_positions(table, request("needle", kind="literal")).orderBy("line").collect()
    assert [(r["line"], r["start_column"], r["end_column"]) for r in got] == [(1, 500, 506), (2, 0, 6)]
    assert got[0]["preview"] == "…" + "x" * 117 + "needle" + "y" * 117 + "…" and got[1]["preview"] == "needle"


def test_cursors_and_chunks():
    assert [search.decode_cursor(x) for x in (None, "", search.encode_cursor(40))] == [0, 0, 40]
    for bad in ("!!", search.encode_cursor(-1), "e30"):
        with pytest.raises(ValueError):
            search.decode_cursor(bad)
    rows = [{"preview": "x" * (n or 0)} for n in [10] * 250 + [70_000, 5, None]]
    parts = list(search.chunks(iter(rows)))
    assert [len(p) for p in parts] == [200, 50, 1, 2] and sum(parts, []) == rows


def test_merged_terms(work):
    """The same place found by two terms counts once."""
    one = {r["rel_path"]: r["matches"] for r in search.occurrence_counts(work, request("class", kind="literal", case="insensitive")).collect()}
    two = {r["rel_path"]: r["matches"] for r in search.occurrence_counts(work, request("class", ["CLASS"], kind="literal", case="insensitive")).collect()}
    assert one == two and one["alpha.py"] == 2


def test_nearest_rank(spark):
    rng = random.Random(3)
    table = [(g, rng.choice([None, rng.randrange(1000), rng.randrange(5)])) for g in ("a", "a", "a", "b", None) for _ in range(400)] + [("one", 7)]
    groups = {}
    for g, v in table:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["value"] for r in search.nearest_rank(spark.createDataFrame(table, "g string, v int"), "g", "v", p).collect() if r["g"] is not None}
        assert got == {g: sorted(v)[math.ceil(p * (len(v) - 1))] for g, v in groups.items() if g is not None}


def test_redaction(spark):
    rows = [("a.py", "my_credential = abc,def"), ("keys/x.pem", "a = b"), ("b.txt", 'api_key: "two words" end'), ("c.txt", "-----BEGIN X 1-----\nzz\n-----END X 1----- ok"), ("home/.config/gcloud/z", "k = v"), ("d.txt", "nothing = here")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "p string, t string").select("p", search.redact(F.col("p"), F.col("t"))).collect()}
    assert got == {"a.py": "my_credential = [REDACTED]", "keys/x.pem": "a = [REDACTED]", "b.txt": "api_key: [REDACTED] end", "c.txt": "[REDACTED] ok", "home/.config/gcloud/z": "k = [REDACTED]", "d.txt": "nothing = here"}


def test_files_and_index(spark, tmp_path):
    root = tmp_path / "w"
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "u.txt").write_bytes(b"\xff\xfe" + "hi!".encode("utf-16le"))
    (root / "b.txt").write_bytes(b"a\x00b")
    (root / "i.png").write_bytes(b"x")
    rows = {r["rel_path"]: r for r in corpus.scan(spark, str(root)).collect()}
    assert set(rows) == {*FILES, "u.txt"} and rows["u.txt"]["text"] == "hi!" and rows["docs.md"]["text"] == FILES["docs.md"]
    s = corpus.scan_stats(spark, str(root)).first()
    assert (s["visited"], s["indexed"], s["skipped_binary"], s["skipped_binary_extension"], s["decoded_utf16"]) == (7, 5, 1, 1, 1)
    table = corpus.scan(spark, str(root)).withColumn("doc_id", F.xxhash64("rel_path"))
    corpus.write_index(table, str(tmp_path / "ix"))
    docs, posts = corpus.read_index(spark, str(tmp_path / "ix"))
    assert docs.count() == 5 and posts.where("gram = 'alph'").count() == 1


def test_overlay_stream(spark, tmp_path):
    changes = [("create", "a", None, 1), ("modify", "./b", None, 1), ("rename", "a", "c", 2), ("delete", "b", None, 3), ("modify", "d\\e", None, 4)]
    schema = "kind string, rel_path string, new_rel_path string, generation long"
    for k, part in enumerate((changes[:2], changes[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    overlay.start(stream, f"{tmp_path}/ov", f"{tmp_path}/cp").awaitTermination()
    got = {r["rel_path"]: r["tombstone"] for r in overlay.latest(overlay.read(spark, f"{tmp_path}/ov")).collect()}
    batch = spark.createDataFrame([(*c, i) for i, c in enumerate(changes)], schema + ", seq long")
    want = {r["rel_path"]: r["tombstone"] for r in overlay.latest(overlay.apply_batch(batch)).collect()}
    assert got == want == {"a": True, "b": True, "c": False, "d/e": False}
    base = spark.createDataFrame([("a", "old"), ("z", "kept")], "rel_path string, text string")
    texts = overlay.apply_batch(batch).withColumn("text", F.lit("new"))
    assert {tuple(r) for r in overlay.merged(base, texts).collect()} == {("z", "kept"), ("c", "new"), ("d/e", "new")}


def test_overlay_compaction(spark, tmp_path):
    """Folding keeps the latest row of each path, batches after it count, parts of batches do not, and the base takes all in."""
    schema = "kind string, rel_path string, new_rel_path string, generation long, seq long"
    path = f"{tmp_path}/ov"

    def batch(k, *changes):
        overlay.apply_batch(spark.createDataFrame([(*c, i) for i, c in enumerate(changes)], schema)).withColumn("text", F.lit(f"v{k}")).write.parquet(f"{path}/batch={k}")

    state = lambda: {r["rel_path"]: (r["tombstone"], r["text"]) for r in overlay.latest(overlay.read(spark, path)).collect()}
    assert state() == {}
    overlay.compact(spark, path)
    batch(0, ("modify", "a", None, 1), ("modify", "b", None, 1))
    batch(1, ("modify", "a", None, 1), ("delete", "c", None, 2))
    before = state()
    assert before == {"a": (False, "v1"), "b": (False, "v0"), "c": (True, "v1")}
    overlay.compact(spark, path)
    assert state() == before and overlay.read(spark, path).count() == 3 and not (tmp_path / "ov" / "batch=0").exists()
    batch(2, ("delete", "a", None, 3))
    (tmp_path / "ov" / "batch=3").mkdir()
    overlay.compact(spark, path)
    assert state() == before | {"a": (True, "v2")} and overlay.next_generation(overlay.read(spark, path)) == 4
    base = spark.createDataFrame([("a", "old"), ("z", "kept"), ("c", "old")], "rel_path string, text string")
    new = overlay.compact_base(spark, base, path, f"{tmp_path}/base")
    assert {tuple(r) for r in new.collect()} == {("z", "kept"), ("b", "v0")} and state() == {}
    batch(3 + 1, ("modify", "q", None, 5))
    assert state() == {"q": (False, "v4")}


def test_pending_and_reconcile(spark):
    changes = spark.createDataFrame([("modify", "a", 1, 0), ("delete", "a", 1, 1), ("modify", "b", 2, 0)], "kind string, rel_path string, generation long, seq long")
    assert {(r["rel_path"], r["kind"]) for r in overlay.coalesce_pending(changes).collect()} == {("a", "delete"), ("b", "modify")}
    now, then = (spark.createDataFrame(x, "rel_path string, modified_unix_secs long") for x in ([("a", 1), ("b", 3), ("n", 1)], [("a", 1), ("b", 2), ("g", 1)]))
    assert {tuple(r) for r in overlay.reconcile(now, then).collect()} == {("b", "modify"), ("n", "modify"), ("g", "delete")}
    assert overlay.is_stale({"head": "x", "branch": "main"}, "y", "main") and not overlay.is_stale({"head": "x", "branch": "main"}, "x", "main")


def test_calls_and_hierarchy(spark):
    cols = "id string, name string, qualified_name string, kind string, language string, rel_path string, container_id string, extends_names array<string>, implements_names array<string>"
    s = spark.createDataFrame([("B", "Base", "Base", "class", "py", "a.py", None, None, None), ("C", "Child", "Child", "class", "py", "b.py", None, ["Base"], None), ("B.run", "run", "Base.run", "method", "py", "a.py", "B", None, None), ("C.run", "run", "Child.run", "method", "py", "b.py", "C", None, None), ("f", "go", "go", "function", "py", "b.py", None, None, None)], cols)
    closure = graph.descendants(graph.parents(s))
    assert [tuple(r) for r in closure.collect()] == [("B", "C")]
    assert [tuple(r) for r in graph.member_implementations(s, closure).collect()] == [("B.run", "C.run")]
    calls = spark.createDataFrame([(1, "run", "super", "b.py", "py", "C", "C.run"), (2, "run", "self", "b.py", "py", "C", "C.run"), (3, "go", None, "z.py", "py", None, "f"), (4, "Child", None, "z.py", "py", None, "f"), (5, "run", "x", "z.py", "py", None, "f"), (6, "run", "y", "z.py", "py", None, "f")], "call_id long, name string, receiver string, rel_path string, language string, container_id string, enclosing_symbol_id string")
    bindings = spark.createDataFrame([("f", "x", "C")], "enclosing_symbol_id string, variable string, class_id string")
    got = {(r["call_id"], r["callee_id"], r["confidence"]) for r in graph.resolve_calls(calls, s, closure, bindings).collect()}
    assert got == {(1, "B.run", "resolved"), (2, "C.run", "exact"), (3, "f", "resolved"), (4, "C", "exact"), (5, "C.run", "exact")}


def test_queries_have_sql():
    catalog = importlib.import_module("quillon.plans.catalog")
    importlib.import_module("quillon.plans.catalog_requests")
    assert len(catalog.QUERIES) > 100 and set(catalog.SQL) == set(catalog.QUERIES)


def test_entry_without_training_data(tmp_path):
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('quillon.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries())\n"
    code += "from pyspark.sql import SparkSession\nimport os\nif os.path.exists('/root/testdata/sf0.001'):\n    assert e.entry(SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).count() > 0\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_typed_gram_df(spark, monkeypatch):
    """Documents by kind and gram against plain sets; the counts a task hands on early add up, and no gram goes row by row to a shuffle."""
    texts = [("a/한국.txt", "Ab abcde ABCDEFGHIJ ab x 한국어지원 \U0001d4d0\U0001d4d1z"), ("b/ab.txt", "ab_c1, abcdefghi... q"), ("c", None), ("d", ""), ("abcd", "abcd " * 500)]
    want = {}
    for path, text in texts:
        of = lambda kind, t: {(kind, t[i : i + w]) for w in (2, 3, 4) for i in range(len(t) - w + 1)}
        words = lambda s: re.findall(r"\w+", s.lower())
        for g in set().union(*(of("path", t) for t in words(path)), *(of("short" if len(t) <= 4 else "medium" if len(t) <= 8 else "long", t) for t in words(text or ""))):
            want[g] = want.get(g, 0) + 1
    rows = spark.createDataFrame(texts, "rel_path string, text string").repartition(2, "rel_path")
    for most, held in ((1 << 18, 256), (1, 1)):
        monkeypatch.setattr(corpus, "MOST_COUNTS", most)
        monkeypatch.setattr(corpus, "SLICE", held)
        assert {(r["kind"], r["gram"]): r["df"] for r in corpus.typed_gram_df(rows).collect()} == want
    from __spark_entry__ import queries

    plan = queries()["typed_grams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
