"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, sheltered, table

#: Hashed counts of characters, pairs and triples of the UTF-8 bytes.
WIDTH = 2048
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Documents that the classifiers are fitted on, all languages together; the bound of what reaches the driver.
SAMPLE = 4000
RIDGE = 1.0
UNKNOWN = "und"
PIECE = 1 << 22


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of a lower-cased text, of length 1."""
    data = text.lower().encode("utf-8", "replace")
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, max(1, len(data)), PIECE):  # pieces share two bytes, so that no gram is lost
        x = np.frombuffer(data[max(0, at - 2) : at + PIECE], np.uint8).astype(np.uint32)
        skip = min(at, 2)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, 4):
            h = (x if n == 1 else h[:-1] + x[n - 1 :]) * np.uint32(MULTIPLIERS[n - 1])
            h ^= h >> np.uint32(15)
            new = h[max(0, skip - n + 1) :]
            counts += np.bincount(new % np.uint32(WIDTH), minlength=WIDTH)
    v = np.sqrt(counts)
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 20) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss: finite Newton steps on the rows within the margin. y: 1 or -1."""
    z = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    w = np.zeros(z.shape[1])
    active = np.ones(len(z), bool)
    for _ in range(rounds):
        a, t = z[active], y[active].astype(np.float64)
        if len(a) < z.shape[1]:  # the dual is smaller
            w = a.T @ np.linalg.solve(a @ a.T + ridge * 0.01 * np.eye(len(a)), t)
        else:
            w = np.linalg.solve(a.T @ a + ridge * 0.01 * np.eye(z.shape[1]), a.T @ t)
        now = y * (z @ w) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return w.astype(np.float32)


def families(centres: np.ndarray) -> list[list[int]]:
    """Groups of profiles by average linkage of their cosines: two groups are of one family if they are as near to each other as two languages are on average."""
    groups = [[k] for k in range(len(centres))]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    usual = near[~np.eye(len(near), dtype=bool)].mean() if len(near) > 1 else 1.0
    while len(groups) > 1:
        score, a, b = max((near[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a, b in combinations(range(len(groups)), 2))
        if score < usual - 1e-6:
            break
        groups[-a] += groups.pop(-b)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    """Families of languages, a machine for each family against the rest, and one for each pair of languages of a family."""

    langs: list[str]
    groups: list[list[int]] = field(default_factory=list)
    family: np.ndarray | None = None
    pairs: dict[tuple[int, int], int] = field(default_factory=dict)
    machines: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> Model:
        model = cls(sorted(set(lang)))
        y = np.array([model.langs.index(s) for s in lang])
        if len(model.langs) < 2:
            model.groups = [[0]] if model.langs else []
            return model
        model.groups = families(np.stack([x[y == k].mean(0) for k in range(len(model.langs))]))
        of = np.zeros(len(model.langs), int)
        for g, members in enumerate(model.groups):
            of[members] = g
        machine = lambda g: svm(x, np.where(of[y] == g, 1, -1)) if len(model.groups) > 1 else np.zeros(x.shape[1] + 1, np.float32)
        model.family = np.stack([machine(g) for g in range(len(model.groups))])
        own = []
        for members in model.groups:
            for a, b in combinations(members, 2):
                rows = (y == a) | (y == b)
                model.pairs[a, b] = len(own)
                own.append(svm(x[rows], np.where(y[rows] == a, 1, -1)))
        model.machines = np.stack(own) if own else None
        return model

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the family's share times the weakest vote for the winner."""
        if not self.langs:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        if self.family is None:
            return [self.langs[0]] * len(x), np.ones(len(x))
        z = np.hstack((x, np.ones((len(x), 1), np.float32)))
        margin = z @ self.family.T
        soft = np.exp(3 * (margin - margin.max(1, keepdims=True)))
        soft /= soft.sum(1, keepdims=True)
        first = margin.argmax(1)
        votes = z @ self.machines.T if self.machines is not None else None
        out, score = np.zeros(len(x), int), soft[np.arange(len(x)), first].astype(np.float64)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(first == g)
            if len(members) == 1:
                out[rows] = members[0]
            elif len(rows):
                won, total, weakest = (np.zeros((len(rows), len(members))) for _ in range(3))
                weakest += np.inf
                for (i, a), (j, b) in combinations(enumerate(members), 2):
                    v = votes[rows, self.pairs[a, b]]
                    won[:, i] += v > 0
                    won[:, j] += v <= 0
                    total[:, i] += v
                    total[:, j] -= v
                    weakest[:, i] = np.minimum(weakest[:, i], v)
                    weakest[:, j] = np.minimum(weakest[:, j], -v)
                best = (won + 1e-3 * np.tanh(total)).argmax(1)
                out[rows] = np.array(members)[best]
                score[rows] *= 1 / (1 + np.exp(-3 * weakest[np.arange(len(rows)), best]))
        return [self.langs[k] for k in out], score.clip(0, 1)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about sample of docs(doc_id, text, lang): an equal share of each language, by a hash of the text.

    Only rows with a language and a letter in the text take part. All rows are counted; the hash's threshold for a language
    follows its count, so the sample is the same on each run and what reaches the driver is bounded. Of more than sample
    languages, the most frequent are learned.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return Model([])
    each = max(1, sample // len(counts))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    drawn = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(x, pa.binary())], names=["lang", "x"])

    got = drawn.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    return Model.fit(np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH), got["lang"].to_pylist()) if len(got) else Model([])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with lang_pred and score in place of the text; `und` and 0 if it is null or has no letter.

    Whole texts are read, however long; equal texts get equal results; a tie of votes goes to the larger sum of margins, then
    to the language that is first by name; an empty table gives no rows. Columns of docs that have the names of results give
    way to them, others pass through.
    """
    kept = docs.drop("lang_pred", "score")
    docs, names = sheltered(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c not in ("text", "_letters")]
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            known = [i for i, x in enumerate(batch["_letters"].to_pylist()) if x]
            text = batch["text"]
            for at in range(0, len(known), 1024):
                some = known[at : at + 1024]
                lang, s = model.predict(np.stack([features(text[i].as_py()) for i in some]))
                score[some] = s
                for i, x in zip(some, lang, strict=True):
                    pred[i] = x
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(pred, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    schema = docs.drop("text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    out = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
    return out.select(*(F.col(names[c]).alias(c) for c in kept.columns if c != "text"), "lang_pred", "score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out. A null doc_id is not held out, nor learned from."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"), model)
