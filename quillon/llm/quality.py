"""Quality rules: statistics of each text, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, sheltered, table

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
CONTINUATION = bytes(range(0x80, 0xC0))
LEAST_WORDS = 50
#: Share of a group's documents that the minimum covariance determinant rests on.
HALF = 0.75
#: Standard deviations below which no transformed statistic counts as narrow: length, word length, symbols, equal lines, repeats.
#: From sound documents labelled good in sf0.1: length deviates by 0.83 and word length by 0.03; symbols are 0 up to the last
#: percent; equal lines and repeats are mostly 0, but reach 0.58 and 0.53 in some clean texts.
FLOORS = (0.8, 0.05, 0.02, 0.2, 0.2)
#: Documents that the estimate of the level above weighs: a group of n rests by n / (n + PRIOR) on its own documents.
PRIOR = 50
#: Cells of statistics are this part of the floors wide; they double in width until there are MOST_CELLS at most.
FINE, MOST_CELLS = 0.125, 1 << 18
#: Groups whose estimates are broadcast, at most.
MOST_GROUPS = 1 << 16
RANDOM_STARTS, MOST_STEPS = 6, 60
# fixed values: quantiles of chi-squared with 5 degrees of freedom at 0.975 and 0.999, and the factors that make covariances
# of the closest 0.75 and 0.975 consistent
NEAR, CUTOFF = 12.8325, 20.515
FACTOR_HALF, FACTOR_NEAR = 1.41207, 1.05553


def statistics(text: bytes | None) -> tuple[int, ...]:
    """STATS of a text in UTF-8; all 0 for null."""
    text = text or b""
    words = text.split()  # bytes: ASCII white space only
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    n = len(words)
    repeats = 0
    if n > 3:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + w[2:]
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[place] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeats = int(covered.sum())
    return n, len(joined.translate(None, CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with STATS, all long, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in batch["text"].to_pylist()], np.int64).reshape(-1, len(STATS))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=[*rest, *STATS])

    schema = docs.drop("text").select("*", *(F.lit(0).cast("long").alias(c) for c in STATS)).schema
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """Length, mean word length, symbols, equal lines and repeated words, on scales on which they spread evenly."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / words),
        F.log1p(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


P = len(FLOORS)
UPPER = [(i, j) for i in range(P) for j in range(i, P)]


def blended(x: np.ndarray, v: np.ndarray, factor: float, prior: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of points with weights v and of PRIOR more that are spread as the level above; variances have floors."""
    h, (above, spread) = v.sum(), prior
    own = v @ x / max(h, 1e-300)
    d = x - own
    cov = factor * (d * v[:, None]).T @ d
    gap = own - above
    whole = h + PRIOR
    cov = (cov + PRIOR * spread + h * PRIOR / whole * np.outer(gap, gap)) / whole
    cov[np.diag_indices(P)] = np.maximum(cov.diagonal(), np.square(FLOORS))
    return (h * own + PRIOR * above) / whole, cov


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)


def closest(d: np.ndarray, w: np.ndarray, h: float) -> np.ndarray:
    """Weights of the points that are closest, h in all: the last of them counts in part."""
    order = np.argsort(d, kind="stable")
    before = np.cumsum(w[order]) - w[order]
    v = np.zeros(len(w))
    v[order] = np.clip(h - before, 0, w[order])
    return v


def starts(x: np.ndarray, w: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and covariances from which concentration begins: the level above, medians with quartile spreads, bounded and sign correlations, a few points."""
    found = [prior]
    quartiles = np.zeros((3, P))
    for j in range(P):
        order = np.argsort(x[:, j], kind="stable")
        part = np.cumsum(w[order]) / w.sum()
        quartiles[:, j] = x[order, j][np.searchsorted(part, (0.25, 0.5, 0.75)).clip(max=len(x) - 1)]
    scale = np.maximum((quartiles[2] - quartiles[0]) / 1.349, FLOORS)
    found.append((quartiles[1], np.diag(scale**2)))
    z = (x - quartiles[1]) / scale
    for y in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)):
        d = y - w @ y / w.sum()
        cov = (d * w[:, None]).T @ d / w.sum() + 1e-3 * np.eye(P)
        found.append((quartiles[1], cov * np.outer(scale, scale)))
    rng = np.random.default_rng(5)
    for _ in range(RANDOM_STARTS):
        v = np.zeros(len(x))
        np.add.at(v, rng.choice(len(x), P + 1, p=w / w.sum()), 1.0)
        found.append(blended(x, v, 1.0, prior))
    return found


def robust(x: np.ndarray, w: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance by the minimum covariance determinant, of points with weights.

    From each start, concentration steps take the closest HALF and estimate anew until that is the same again; the start
    that ends at the least determinant counts. Then all that is near by it is estimated from once more.
    """
    order = np.lexsort(x.T)
    x, w = x[order], w[order].astype(float)
    best = None
    for mean, cov in starts(x, w, prior):
        last = None
        for _ in range(MOST_STEPS):
            v = closest(distances(x, mean, cov), w, HALF * w.sum())
            if last is not None and np.array_equal(v, last):
                break
            last = v
            mean, cov = blended(x, v, FACTOR_HALF, prior)
        size = np.linalg.slogdet(cov)[1]
        if best is None or size < best[0] - 1e-9:
            best = size, mean, cov
    return blended(x, w * (distances(x, *best[1:]) <= NEAR), FACTOR_NEAR, prior)


ROOT = np.array([np.log1p(300.0), np.log1p(5.0), 0.0, 0.0, 0.0]), np.diag(np.square(FLOORS))
FIT = "mean array<double>, cov array<double>"


def _fit(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells(by, n, s0.., mean, cov) to (by, mean, cov): the estimate of each group from the one of the level above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prior = np.array(pdf["mean"].iloc[0]), np.array(pdf["cov"].iloc[0]).reshape(P, P)
        w = pdf["n"].to_numpy(float)
        mean, cov = robust(np.stack([pdf[f"s{i}"].to_numpy(float) for i in range(P)], axis=1) / w[:, None], w, prior)
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in by}, "mean": [mean], "cov": [cov.ravel()]})

    return cells.groupBy(*by).applyInPandas(run, ", ".join(f"{c} string" for c in by) + ", " + FIT)


def _precision(fit: DataFrame, by: list[str]) -> DataFrame:
    """fit(by, mean, cov) to (by, mean, prec): inverse covariance, upper triangle, off-diagonals doubled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inverses = [np.linalg.inv(np.reshape(c, (P, P))) for c in pdf["cov"]]
            yield pdf[[*by, "mean"]].assign(prec=[[m[i, j] * (1 if i == j else 2) for i, j in UPPER] for m in inverses])

    return fit.mapInPandas(run, ", ".join(f"{c} string" for c in by) + ", mean array<double>, prec array<double>")


def _distance() -> Column:
    x = [F.col(f"_x{i}") - F.col("mean")[i] for i in range(P)]
    return sum((F.col("prec")[k] * x[i] * x[j] for k, (i, j) in enumerate(UPPER)), F.lit(0.0))


def _cells(core: DataFrame) -> DataFrame:
    """(_lang, _source, k0.., n, s0..): counts and sums of all documents by cell of their statistics, MOST_CELLS different ones at most."""
    sums, keys = [F.sum(f"_x{i}").alias(f"s{i}") for i in range(P)], [f"k{i}" for i in range(P)]
    at = [F.floor(F.col(f"_x{i}") / (f * FINE)).alias(f"k{i}") for i, f in enumerate(FLOORS)]
    cells = cut(core.select("_lang", "_source", *at, *(f"_x{i}" for i in range(P))).groupBy("_lang", "_source", *keys).agg(F.count(F.lit(1)).alias("n"), *sums), "cells")
    while cells.select(*keys).distinct().count() > MOST_CELLS:
        wider = cells.withColumns({k: F.floor(F.col(k) / 2) for k in keys})
        cells = cut(_merged(wider, ["_lang", "_source", *keys]), "cells")
    return cells


def _merged(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(P)))


def _given(cells: DataFrame, estimate: tuple[object, object]) -> DataFrame:
    """cells with one estimate as that of the level above."""
    return cells.withColumns({c: F.array(*(F.lit(float(x)) for x in np.ravel(a))) for c, a in zip(("mean", "cov"), estimate, strict=True)})


def judge(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats(lang, source, STATS, ...) with base_failed, distance and kept.

    Minimum covariance determinant per language and source, over the documents that pass the base rules. They are first
    counted in cells of their statistics, with exact sums, so a group may hold any share of all rows and its estimate is
    made in one task of MOST_CELLS points at most; with fewer documents than cells they are the documents themselves. All
    documents, those of a language, and those of a language and source are estimated in turn, each with PRIOR documents
    more that are spread as the level above: one rule for groups of any size. Variances have floors, so a statistic that
    is constant in the core does not condemn whoever differs a little. A document is rejected if its squared distance is
    beyond the cutoff, or if it fails the base rules; distance is null then. Null language or source is a value of its
    own. Equal rows get equal verdicts; an empty table gives no rows. Extra columns pass through, but those named as the
    results give way, and none may begin with an underscore.
    """
    at = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source")]
    rows = stats.drop("base_failed", "distance", "kept").withColumns({"base_failed": base_failed(), "_lang": at[0], "_source": at[1]}).withColumns({f"_x{i}": x for i, x in enumerate(transformed())})
    keys = [f"k{i}" for i in range(P)]
    cells = _cells(rows.where(~F.col("base_failed")))
    whole = _fit(_given(_merged(cells, keys).withColumn("_all", F.lit("")), ROOT), ["_all"]).first()  # one row
    by_lang = cut(_fit(_given(_merged(cells, ["_lang", *keys]), (whole["mean"], whole["cov"]) if whole else ROOT), ["_lang"]), "fit")
    fit = cut(_precision(_fit(cells.join(by_lang, "_lang"), ["_lang", "_source"]), ["_lang", "_source"]), "fit")
    fit = F.broadcast(fit) if fit.count() <= MOST_GROUPS else fit
    out = rows.join(fit, ["_lang", "_source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
    return out.drop("_lang", "_source", "mean", "prec", *(f"_x{i}" for i in range(P)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judge(cut(stats, "counted")).select("doc_id", *STATS[:-1], "base_failed", "kept", "distance")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    plain, names = sheltered(docs, "text", "lang", "source")
    rows = plain.withColumn("_row", F.monotonically_increasing_id())
    judged = judge(cut(with_statistics(rows.select("_row", "text", "lang", "source").withColumnRenamed("_row", "row")), "counted"))
    return rows.join(judged.where("not kept").select(F.col("row").alias("_row")), "_row", "left_anti").select(*(F.col(names[c]).alias(c) for c in docs.columns))
