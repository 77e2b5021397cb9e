"""Planner, globs and patterns in plain Python."""

import re

import pytest

from quillon.functions.globs import Scope, glob_regex
from quillon.functions.grams import query_grams, selective_grams
from quillon.plans.query import RiskyQuery, plan, request
from quillon.plans.regex import ANY, Need, requirement


def literals(need):
    return {need.text} if need.kind == "lit" else {x for p in need.parts for x in literals(p)} if need.kind == "and" else set()


def test_required_literals():
    assert literals(requirement("foo.*bar(baz)?qux")) == {"foo", "bar", "qux"}
    assert literals(requirement("colou?r")) == {"colo", "r"}
    assert requirement("foo|bar") == Need("or", parts=(Need("lit", "foo"), Need("lit", "bar")))
    assert literals(requirement("ab+c")) == {"ab", "c"}
    assert requirement("(?i)foo") == ANY and requirement(r"foo\p{L}") == ANY
    assert requirement("[a-e][a-e][a-e]") == ANY
    assert literals(requirement(r"a\.b\(c")) == {"a.b(c"}


@pytest.mark.parametrize("pattern", ["ab+c", "a{2,3}b", "(?:a|abc)d", "x(yz)*w", "foo(bar|baz)qux", "(ab)+c", "a?b{0}cd", "wor[dk]s?", "a(b|c(d|e)f)g"])
def test_requirement_is_sound(pattern):
    import itertools

    def holds(need, text):
        if need.kind == "any":
            return True
        if need.kind == "lit":
            return need.text in text
        return (all if need.kind == "and" else any)(holds(p, text) for p in need.parts)

    need = requirement(pattern)
    letters = sorted(set(re.sub(r"[^a-z]", "", pattern)))[:7]
    texts = ["".join(t) for n in range(1, 5) for t in itertools.product(letters, repeat=n)] + ["fooquxbar", "foobarqux", "foobazqux", "words", "works", "xyzyzw", "xw", "abbbbc", "abcdef"]
    assert all(holds(need, t) for t in texts if re.search(pattern, t))


def test_globs():
    hit = lambda g, p: bool(re.search(glob_regex(g), p))
    assert hit("src/*.rs", "src/a.rs") and not hit("src/*.rs", "src/x/a.rs")
    assert hit("**/*.py", "a.py") and hit("**/*.py", "x/y/a.py")
    assert hit("**/test/**", "a/test/b") and hit("a?.rs", "ab.rs") and not hit("a?.rs", "a/.rs")
    assert hit("[!ab].c", "c.c") and not hit("[!ab].c", "a.c") and hit("한*.md", "한국어.md")
    scope = Scope.parse("src/, !gen, +x.py")
    assert scope.include == ["src/**", "**/src/**", "**/x.py", "**/x.py/**"] and scope.exclude == ["**/gen", "**/gen/**"]


def test_requests():
    assert request("/a.b/").mode == "regex" and request("plain text").mode == "literal" and request(r"\d+ x", allow_broad=True).mode == "regex"
    r = request("f:src/.*py needle")
    assert r.scope.path_regex == "src/.*py" and r.terms == ["needle"]
    assert request("Abc").case_sensitive and not request("abc").case_sensitive
    for bad in (".*", r"(?<=a)b", r"(a)\1"):
        with pytest.raises(RiskyQuery):
            request(bad, kind="regex")


def test_plan():
    assert plan(request("ab", kind="literal")) == [frozenset({"ab"})]
    assert plan(request("a", kind="literal")) is None
    two = plan(request("AlphaService", ["BetaService"], kind="literal"))
    assert len(two) == 2 and two[0] != two[1]
    assert len(selective_grams("one two three four five six")) <= 12
    assert "vice" in query_grams("AlphaService handles users")
