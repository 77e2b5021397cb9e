"""Tokens, grams and trigrams: Column expressions for documents, and plain Python for queries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from itertools import chain, islice

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters are Unicode letters, numbers and the underscore, in Java's and Python's terms alike.
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}_]+"
WIDTHS = (4, 3, 2)
MOST_GRAMS = 8192
#: Tokens whose grams a task remembers.
MOST_TOKENS = 1 << 17
#: Limits of a query's grams: tokens and grams, for one line and for several.
BUDGETS = {False: (4, 12), True: (8, 24)}


def tokens(c: Column) -> Column:
    """Lower-cased word tokens."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda t: F.length(t) > 0)


def token_class(t: Column) -> Column:
    return F.when(F.length(t) <= 4, "short").when(F.length(t) <= 8, "medium").otherwise("long")


def raw_tokens(c: Column) -> Column:
    """The lower-cased parts between runs of other characters; empty ones among them."""
    return F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD)


class Cutter:
    """Grams of tokens, remembered for those seen before: MOST_TOKENS at most."""

    def __init__(self) -> None:
        self.known: dict[str, dict[str, None]] = {}

    def of(self, token: str) -> dict[str, None]:
        """All windows of the widths, widest first, each once; none for tokens of one character."""
        if (found := self.known.get(token)) is None:
            found = dict.fromkeys(token[i : i + w] for w in WIDTHS for i in range(len(token) - w + 1))
            if len(self.known) >= MOST_TOKENS:
                self.known.clear()
            self.known[token] = found
        return found

    def document(self, path: list[str], text: list[str]) -> tuple[dict[str, None], bool]:
        """Distinct grams of the path's tokens and then the text's, MOST_GRAMS at most, and whether that cut them."""
        found: dict[str, None] = {}
        for t in dict.fromkeys(chain(path, text)):
            found.update(self.of(t))
        return (dict.fromkeys(islice(found, MOST_GRAMS)), True) if len(found) > MOST_GRAMS else (found, False)


#: Kinds of grams: those of the path, and those of the text's tokens by their class.
KINDS = ("path", "short", "medium", "long")


def typed(cutter: Cutter, path: list[str], text: Iterable[str]) -> tuple[set[str], ...]:
    """Distinct grams of a document by KINDS: of the path's tokens, and of the text's tokens by their class."""
    own: tuple[list[dict[str, None]], ...] = ([cutter.of(t) for t in path], [], [], [])
    for t in text:
        own[1 if len(t) <= 4 else 2 if len(t) <= 8 else 3].append(cutter.of(t))
    return tuple(set().union(*x) for x in own)


_WORDS = re.compile(r"[^\W]+")


def query_tokens(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def query_grams(text: str) -> list[str]:
    out = [t[i : i + w] for t in query_tokens(text) for w in WIDTHS for i in range(len(t) - w + 1)]
    return list(dict.fromkeys(out))


def selective_grams(text: str) -> list[str]:
    """Grams of the longest distinct tokens, within the budget: a subset, so pruning by them is safe."""
    most_tokens, most = BUDGETS["\n" in text]
    chosen = sorted(dict.fromkeys(t for t in query_tokens(text) if len(t) > 1), key=len, reverse=True)[:most_tokens]
    each = math.ceil(most / max(1, len(chosen)))
    return list(dict.fromkeys(g for t in chosen for g in query_grams(t)[:each]))[:most]

