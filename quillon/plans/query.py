"""Search requests: parsing, smart case, the risk gate, and the plan of grams that prunes candidates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quillon.functions.globs import Scope
from quillon.functions.grams import selective_grams
from quillon.plans.regex import ANY, Need, requirement

WORD_CHAR = r"[\p{IsAlphabetic}\p{N}_]"
#: Most alternatives of the boolean query; beyond it the scan is not pruned.
MOST_BRANCHES = 64


class RiskyQuery(ValueError):
    """The regular expression is too broad to run unasked."""


@dataclass
class Request:
    terms: list[str]
    mode: str = "literal"
    case: str = "auto"
    whole_word: bool = False
    multiline: bool = False
    scope: Scope = field(default_factory=Scope)
    allow_broad: bool = False

    @property
    def case_sensitive(self) -> bool:
        return self.case == "sensitive" or (self.case == "auto" and any(c.isupper() for t in self.terms for c in t))


def request(query: str, queries: list[str] | None = None, kind: str = "auto", **options) -> Request:
    """auto: `/x/` and what looks like a regex are one, `file:` or `f:` fields select paths, else a literal. Terms are a union."""
    terms, scope = [query, *(queries or [])], options.pop("scope", Scope())
    if kind in ("auto", "field") and (m := re.match(r"""(?:f|file):("[^"]*"|'[^']*'|\S+)\s+(.*)$""", query, re.S)):
        scope.path_regex, terms[0] = m[1].strip("\"'"), m[2].strip()
        kind = "auto"
    regex = kind == "regex"
    if kind == "auto" and (m := re.fullmatch(r"/(.+)/", terms[0], re.S)):
        terms[0], regex = m[1], True
    elif kind == "auto":
        regex = bool(re.search(r"\\[dwsbDWSB.]|\.\*|\.\+|\[[^\]]+\][*+?{]|\(\?:|[^\\]\|", terms[0]))
    terms = list(dict.fromkeys(t for t in terms if t))
    out = Request(terms, "regex" if regex else "literal", scope=scope, **options)
    if regex:
        check_risk(out)
    return out


def check_risk(r: Request) -> None:
    """Patterns that no literal narrows, over several lines or with repeats of anything, need leave."""
    for t in r.terms:
        if re.search(r"\(\?[=!<]|\\[1-9]", t):
            raise RiskyQuery(f"look-around and back references are not supported: {t}")
        broad = requirement(t) == ANY and (r.multiline or re.fullmatch(r"(\.[*+]|\[.*\][*+]|\\[wsSWdD][*+]|\^|\$)+", t))
        if broad and not r.allow_broad:
            raise RiskyQuery(f"no literal narrows this pattern: {t}")


def quote(literal: str) -> str:
    """Java's quoting, which holds for any character."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def pattern(r: Request, term: str) -> str:
    """The Java pattern of one term. Case folds by Unicode; word ends are where no letter, number or underscore is next."""
    body = term if r.mode == "regex" else quote(term)
    if r.whole_word:
        body = f"(?<!{WORD_CHAR})(?:{body})(?!{WORD_CHAR})"
    flags = "" if r.case_sensitive else "iu"
    if r.mode == "regex":
        flags += "Ums" if r.multiline else "U"
    return (f"(?{flags})" if flags else "") + body


def any_pattern(r: Request) -> str:
    return "|".join(f"(?:{pattern(r, t)})" for t in r.terms)


def branches(need: Need, fold: bool) -> list[frozenset[str]] | None:
    """Gram sets of which one must be wholly present; None if nothing can be required."""
    if need.kind == "any":
        return None
    if need.kind == "lit":
        text = need.text
        # the lower case of other letters can hang on what stands around them, and s and k fold to more than their own
        parts = re.split(r"[^\x00-\x7F]|[skSK]" if fold else r"[^\x00-\x7F]", text)
        grams = frozenset(g for p in parts for g in selective_grams(p))
        return [grams] if grams else None
    inner = [branches(p, fold) for p in need.parts]
    if need.kind == "or":
        if any(b is None for b in inner):
            return None
        out = list(dict.fromkeys(b for x in inner for b in x))
        return out if len(out) <= MOST_BRANCHES else None
    known = [b for b in inner if b is not None]
    if not known:
        return None
    out = [frozenset()]
    for b in known:
        if len(out) * len(b) <= MOST_BRANCHES:  # leaving one out only widens
            out = [x | y for x in out for y in b]
    return out if all(out) else None


def plan(r: Request) -> list[frozenset[str]] | None:
    """Gram sets, one of which every matching document has; None to scan all. Grams are lower case on both sides."""
    out: list[frozenset[str]] = []
    for t in r.terms:
        need = requirement(t) if r.mode == "regex" else Need("lit", t)
        own = branches(need, fold=r.mode == "regex" and not r.case_sensitive or r.mode == "literal" and not r.case_sensitive)
        if own is None:
            return None
        out += own
    return list(dict.fromkeys(out)) or None
