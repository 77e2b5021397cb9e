"""License scans: exact phrases, and an exact set-similarity join of license templates with the blocks of all texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Phrases of the base, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Public license texts and notices by the label that a block near them gets, and words without which it does not.
TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache"),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions binary",
    ),
    "bsd-notice": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    "cc-by-nc": ("licensed under cc by nc", "cc nc"),
    "cc-by-sa": ("licensed under cc by sa", "cc sa"),
    "gpl-notice": ("this work is licensed under the gnu general public license version", "gnu general"),
    "gpl-program": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        "gnu general foundation",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "fee distribute",
    ),
    "mit": ("released under the mit license", "mit"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "sublicense charge",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unencumbered domain",
    ),
}
#: Share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.8
#: A template's blocks are as long as twice its words, in powers of two of so many at least; each begins half a block after the last.
LEAST_BLOCK = 16


def block_of(text: str) -> int:
    """The block of a template: a copy of the template lies within one, whose half is at least as long."""
    return max(LEAST_BLOCK, 1 << (2 * len(tokens(text.encode())) - 1).bit_length())


_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else 32 if b in _SEPARATORS else b) for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, split at ASCII other than letters and digits."""
    return (text or b"").translate(TO_WORDS).split()


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all texts; partial counts of a bounded vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(w for w in tokens(text) if w in vocabulary)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # len(vocabulary) rows at most


class Matcher:
    """An index of the templates' rarest tokens, and the filters that lead from a text to the blocks that contain enough."""

    def __init__(self, templates: dict[str, tuple[str, str]], frequency: dict[bytes, int], containment: float = CONTAINMENT):
        rank = lambda w: (frequency.get(w, 0), w)
        sets = {label: sorted(set(tokens(t.encode())), key=rank) for label, (t, _) in templates.items() if tokens(t.encode())}
        self.need = {label: max(1, ceil(containment * len(s) - 1e-9)) for label, s in sets.items()}
        vocabulary = sorted({w for s in sets.values() for w in s} | {w for _, names in templates.values() for w in tokens(names.encode())}, key=rank)
        self.order = {w: k for k, w in enumerate(vocabulary)}
        self.sets = {label: [self.order[w] for w in s] for label, s in sets.items()}
        self.names = {label: frozenset(self.order[w] for w in tokens(templates[label][1].encode())) for label in sets}
        # by length of block: a block with need tokens of a template holds one of its len - need + 1 rarest
        self.index: dict[int, dict[int, list[tuple[str, int]]]] = {}
        for label, s in self.sets.items():
            own = self.index.setdefault(block_of(templates[label][0]), {})
            for at, w in enumerate(s[: len(s) - self.need[label] + 1]):
                own.setdefault(w, []).append((label, at))
        rare = {k for own in self.index.values() for k in own}
        self.rare = frozenset(w for w, k in self.order.items() if k in rare)

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, str, float]]:
        """(start, length, label, containment) of every block that reaches the threshold."""
        if self.rare.isdisjoint(words):
            return
        get = self.order.get
        spots = [(i, k) for i, w in enumerate(words) if (k := get(w)) is not None]
        for length, index in self.index.items():
            half = length // 2
            starts = sorted({b for i, k in spots if k in index for b in ((i // half) * half, (i // half - 1) * half) if b >= 0})
            at = 0
            for start in starts:
                while at < len(spots) and spots[at][0] < start:
                    at += 1
                end, held = at, set()
                while end < len(spots) and spots[end][0] < start + length:
                    held.add(spots[end][1])
                    end += 1
                for label, share in self.match(index, sorted(held)):
                    yield start, length, label, share

    def match(self, index: dict[int, list[tuple[str, int]]], held: list[int]) -> Iterator[tuple[str, float]]:
        seen = set()
        for j, w in enumerate(held):
            for label, i in index.get(w, ()):
                if label in seen:
                    continue
                s, need = self.sets[label], self.need[label]
                # length: the block holds enough tokens; position: enough are left in both from here
                if len(held) < need or 1 + min(len(s) - i - 1, len(held) - j - 1) < need:
                    continue
                seen.add(label)
                shared = len(set(s).intersection(held))
                if shared >= need and self.names[label] <= set(held):
                    yield label, shared / len(s)


def phrase_starts(words: list[bytes], phrase: list[bytes], line: bytes) -> list[int]:
    """Words at which the phrase stands, overlaps included. line: the words, each between spaces."""
    found, key, at, word, last = [], b" " + b" ".join(phrase) + b" ", -1, 0, 0
    while (at := line.find(key, at + 1)) >= 0:
        word += line.count(b" ", last, at)
        last = at
        found.append(word)
    return found


RESULT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())])


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """docs(text, ...) with what was found in place of the text.

    Base: every place of every phrase. Method: tokens are ordered by their frequency in all texts, which one pass counts;
    a second finds each block that holds at least the containment share of a template's distinct tokens, and among them
    the words that name it. Blocks are twice as long as their template and overlap by half. The templates are a fixed
    list, so their index goes along with the code. A null or empty text has no words, no labels and score 0; equal rows get
    equal results; an empty table gives none. score: the best containment found, or 1 where a phrase stands. Columns of docs
    that have the names of results give way to them, others pass through.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = docs.drop(*RESULT.names)
    vocabulary = frozenset(w for pair in templates.values() for t in pair for w in tokens(t.encode()))
    matcher = Matcher(templates, frequencies(docs, vocabulary), containment)
    keys = {label: tokens(p.encode()) for p, label in phrases.items()}
    anchors = frozenset(k[-1] for k in keys.values())

    def one(text: bytes | None) -> tuple:
        words = tokens(text)
        base = {}
        if not anchors.isdisjoint(words):
            line = b" " + b" ".join(words) + b" "
            base = {label: s for label, k in keys.items() if (s := phrase_starts(words, k, line))}
        starts = [s for x in base.values() for s in x]
        near = list(matcher.blocks(words))
        labels = sorted({*base, *(label for _, _, label, _ in near)})
        score = 1.0 if base else max((s for *_, s in near), default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), score, len({b[:2] for b in near})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(one(x) for x in batch["text"].to_pylist()), strict=True)) or [[]] * len(RESULT)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), *(pa.array(x, f.type) for x, f in zip(rows, RESULT, strict=True))], names=[*rest, *RESULT.names])

    kinds = {"int64": "long", "string": "string", "double": "double"}
    schema = docs.drop("text").select("*", *(F.lit(None).cast(kinds[str(f.type)]).alias(f.name) for f in RESULT)).schema
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license labels of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
