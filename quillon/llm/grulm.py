"""Language-model scores: add-half unigrams over all training tokens, and a gated recurrent model with a class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, cut, sheltered, table

#: Frequent words that travel to the executors, so many at most and none longer than HEAD_BYTES; others are joined.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Words the recurrent model knows, with the rest as one and the end of a text: CLASSES classes of PER_CLASS, by frequency.
CLASSES, PER_CLASS = 32, 32
KNOWN = CLASSES * PER_CLASS
REST, END = 0, 1
HIDDEN = 16
#: Truncated backpropagation: streams trained at once at most, steps of a window, and windows of a shard at least.
STREAMS, WINDOW, WINDOWS = 512, 16, 128
#: Rounds of training; they part the training documents among them, and each averages what the shards have learned.
ROUNDS = 2
RATES = (0.03, 0.01)
#: Tokens of a shard, about.
SHARD = 1 << 20
SCORED_AT_ONCE, SCORED_STEPS = 2048, 64
FLUSH = 1 << 18
#: Documents whose words are held at once.
SLICE = 512
CHUNK = 4096


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; the end is not among them."""
    return (text or b"").lower().split()


def training(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 5) != 1, F.lit(True))


def counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; the empty word stands for their ends. Tasks add up first, and hold FLUSH words at most."""

    def out(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(tokens(text))
                seen[b""] += 1
                if len(seen) >= FLUSH:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent words with their counts: the first of them are those the recurrent model knows."""

    def __init__(self, words: list[bytes], n: np.ndarray, ends: int, total: int, distinct: int):
        self.place = {w: k for k, w in enumerate(words)}
        self.n, self.ends, self.total = n, ends, total
        self.whole = total + 0.5 * (distinct + 1)
        self.logs = np.log10((n + 0.5) / self.whole)
        self.end_log = float(np.log10((ends + 0.5) / self.whole))
        mass = np.full(KNOWN, 1e-9)
        known = min(len(n), KNOWN - 2)
        mass[2 : 2 + known] += n[:known] / max(total, 1)
        mass[END] += ends / max(total, 1)
        base = ((n[:known] + 0.5).sum() + ends + 0.5) / self.whole
        self.rest = max(1 - base, 0.5 / self.whole)  # base probability of all words that the model doesn't know
        mass[REST] += self.rest
        self.mass = mass

    @classmethod
    def of(cls, table_: DataFrame, most: int = HEAD) -> Head:
        """The words of highest count, so many that their counts tell them from the rest: a histogram finds the least count."""
        level = F.floor(F.log2(F.col("n").cast("double")) * 64)
        bands = table_.withColumn("level", level).groupBy("level").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
        total, distinct = sum(b["n"] for b in bands), sum(b["words"] for b in bands)
        least, held = None, 0
        for b in bands:
            if (held := held + b["words"]) > most:
                break
            least = b["level"]
        chosen = table_.where((level >= F.lit(least)) & (F.octet_length("word") <= HEAD_BYTES)) if least is not None else table_.limit(0)
        got = chosen.toArrow().sort_by([("n", "descending"), ("word", "ascending")]).to_pydict()
        ends = table_.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = [(w, n) for w, n in zip(got["word"], got["n"], strict=True) if w]
        return cls([w for w, _ in rows], np.array([n for _, n in rows], np.int64), ends, total, distinct)

    @classmethod
    def again(cls, state: dict) -> Head:
        """From the attributes, which travel without the class."""
        head = cls.__new__(cls)
        head.__dict__.update(state)
        return head

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of words and end, and the words' places in the head, -1 for others."""
        get = self.place.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        ids = np.where((at >= 0) & (at < KNOWN - 2), at + 2, REST)
        return np.append(ids, END).astype(np.int32), at


SHAPES = {"x": (KNOWN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (KNOWN, HIDDEN), "wb": (KNOWN,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(mass: np.ndarray) -> np.ndarray:
    """Small random weights, and biases that make the model a unigram model."""
    rng = np.random.default_rng(7)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    for name in ("x", "u", "c", "w"):
        p[name][:] = rng.normal(0, 0.1, SHAPES[name])
    by_class = mass.reshape(CLASSES, PER_CLASS)
    p["cb"][:] = np.log(by_class.sum(1) / mass.sum())
    p["wb"][:] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the recurrent unit: the new state, and what its derivative needs."""
    g = p["x"][x]
    g += p["b"]
    a = h @ p["u"]
    zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    inner = a[:, 2 * HIDDEN :]
    n = np.tanh(g[:, 2 * HIDDEN :] + r * inner)
    return n + z * (h - n), z, r, n, inner


def output(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target: that of its class times that within the class. With grad, adds gradients and returns dh."""
    cls = (y // PER_CLASS).astype(np.uint8)
    logits = h @ p["c"] + p["cb"]
    logits -= logits.max(1, keepdims=True)
    e = np.exp(logits)
    total = e.sum(1)
    rows = np.arange(len(y))
    logp = logits[rows, cls] - np.log(total)
    dh = None
    if grad is not None:
        d = e / total[:, None]
        d[rows, cls] -= 1
        grad["c"] += h.T @ d
        grad["cb"] += d.sum(0)
        dh = d @ p["c"].T
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES))
    for k, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
        if a == b:
            continue
        some = order[a:b]
        span = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
        hs, at = h[some], y[some] - k * PER_CLASS
        logits = hs @ p["w"][span].T + p["wb"][span]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        own = np.arange(b - a)
        logp[some] += logits[own, at] - np.log(total)
        if grad is not None:
            e /= total[:, None]
            e[own, at] -= 1
            grad["w"][span] += e.T @ hs
            grad["wb"][span] += e.sum(0)
            dh[some] += e @ p["w"][span]
    return logp, dh


def train(flat: np.ndarray, stream: np.ndarray, rate: float) -> np.ndarray:
    """Adam over windows of truncated backpropagation; the state is carried from window to window and reset at a text's end."""
    flat = flat.copy()
    p = views(flat)
    streams = min(STREAMS, max(8, len(stream) // (WINDOW * WINDOWS)), max(1, len(stream) // (2 * WINDOW)))
    n = len(stream) // streams
    if n < 2:
        return flat
    lanes = stream[: n * streams].reshape(streams, n).T
    m1, m2, g_flat = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    grad = views(g_flat)
    h = np.zeros((streams, HIDDEN), np.float32)
    for turn, at in enumerate(range(0, n - 1, WINDOW), 1):
        x, y = lanes[at : min(at + WINDOW, n - 1)], lanes[at + 1 : min(at + WINDOW, n - 1) + 1]
        kept, states = [], []
        for t in range(len(x)):
            h = h * (x[t] != END)[:, None].astype(np.float32)
            before = h
            h, z, r, cand, inner = step(p, x[t], before)
            kept.append((before, z, r, cand, inner))
            states.append(h)
        g_flat[:] = 0
        _, d_out = output(p, np.concatenate(states), y.ravel(), grad)
        d_out = d_out.reshape(len(x), streams, HIDDEN)
        dh = np.zeros_like(h)
        d_in = np.zeros((len(x), streams, 3 * HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, cand, inner = kept[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.hstack((dz, dr, dn * r))
            d_in[t] = np.hstack((dz, dr, dn))
            grad["u"] += before.T @ da
            dh = (dh * z + da @ p["u"].T) * (x[t] != END)[:, None]
        d_all = d_in.reshape(-1, 3 * HIDDEN)
        grad["b"] += d_all.sum(0)
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        grad["x"][ids[order][first]] += np.add.reduceat(d_all[order], first)
        g_flat /= x.size
        np.clip(g_flat, -0.05, 0.05, out=g_flat)
        m1 += 0.1 * (g_flat - m1)
        m2 += 0.01 * (g_flat * g_flat - m2)
        scale = rate * (1 - 0.99**turn) ** 0.5 / (1 - 0.9**turn)
        flat -= scale * m1 / (np.sqrt(m2) + 1e-6)
    return flat


def score(flat: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability of each text's ids, whole texts: windows of steps, each from the states of the last."""
    p = views(flat)
    out = np.zeros(len(texts))
    lengths = np.array([len(x) for x in texts], np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    for at in range(0, len(texts), SCORED_AT_ONCE):
        some = by_length[at : at + SCORED_AT_ONCE]
        size, sums = lengths[some], np.zeros(len(some))
        h, last = np.zeros((len(some), HIDDEN), np.float32), np.full(len(some), END, np.int32)
        for begin in range(0, int(size[0]), SCORED_STEPS):
            live = int(np.searchsorted(-size, -begin, "left"))
            steps = min(SCORED_STEPS, int(size[0]) - begin)
            y = np.full((steps, live), -1, np.int32)
            for k in range(live):
                part = texts[some[k]][begin : begin + steps]
                y[: len(part), k] = part
            states, targets, owner = [], [], []
            h, last = h[:live], last[:live]
            for t in range(steps):
                n = int(np.searchsorted(-size[:live], -(begin + t), "left"))
                h = step(p, last[:n], h[:n])[0]
                last = y[t, :n]
                states.append(h)
                targets.append(last)
                owner.append(np.arange(n))
            logp, _ = output(p, np.concatenate(states), np.concatenate(targets))
            sums[:live] += np.bincount(np.concatenate(owner), logp, live)
        out[some] = sums
    return out, lengths


ROWS = {"ids": "binary", "n_tokens": "long", "head_known": "long", "head_base": "double", "rest_base": "double", "rest_tokens": "long", "tail": "array<struct<word:binary,n:int>>"}


def encode(docs: DataFrame, head: Head) -> DataFrame:
    """docs(text, ...) with ROWS in place of the text: the model's ids, two bytes each, and what the unigrams need."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(head))  # HEAD words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Head.again(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # a slice's words are gone before the next one's
                part = batch.slice(at, SLICE)
                rows, words, counts_, ends = [], [], [], [0]
                for text in part["text"].to_pylist():
                    own = tokens(text)
                    ids, place = known.ids(own)
                    found = place[place >= 0]
                    tail = Counter(own[k] for k in np.flatnonzero(place < 0).tolist())
                    words += tail
                    counts_ += tail.values()
                    ends.append(len(words))
                    rest = found[found >= KNOWN - 2]
                    rows.append((ids.astype("<u2").tobytes(), len(ids), len(found) + (known.ends > 0), float(known.logs[found].sum()) + known.end_log, float(known.logs[rest].sum()), int((ids == REST).sum())))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts_, pa.int32())], names=["word", "n"])
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[*names, *ROWS])

    schema = docs.drop("text").select("*", *(F.lit(None).cast(t).alias(c) for c, t in ROWS.items())).schema
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2")


def in_round(turn: int, rounds: int = ROUNDS) -> Column:
    """Whether a document is of this round: each is of exactly one."""
    return F.pmod(F.col("_key"), F.lit(rounds)) == turn


def fit(encoded: DataFrame, head: Head, rounds: int = ROUNDS, shard: int = SHARD) -> np.ndarray:
    """The model's weights after rounds of training on shards of the documents, averaged by tokens after each.

    encoded(_key, ids): the training documents, each of which is trained on once. They are dealt by hash to shards of
    about so many tokens, in an order by hash, so neither batches nor partitions matter. Averages are taken over groups
    of shards and then over these, so none gathers more than the square root of the shards; one set of weights a round
    reaches the driver.
    """
    flat = start(head.mass)
    shards = max(1, round(head.total / rounds / shard))
    parts = int(np.ceil(shards**0.5))

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = sum(n * np.frombuffer(w, np.float64) for n, w in zip(pdf["n"], pdf["w"], strict=True))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [int(pdf["part"].iloc[0]) // parts], "n": [pdf["n"].sum()], "w": [(total / pdf["n"].sum()).tobytes()]})

    def learner(flat: np.ndarray, rate: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_key", "ids"])
            stream = np.concatenate([[END], *(numbers(x) for x in pdf["ids"])]).astype(np.int32)
            weights = train(flat, stream, rate).astype(np.float64)
            out = [weights[a : a + CHUNK].tobytes() for a in range(0, SIZE, CHUNK)]
            return pd.DataFrame({"chunk": range(len(out)), "part": int(pdf["shard"].iloc[0]), "n": len(stream), "w": out})

        return learn

    for turn in range(rounds):
        dealt = encoded.where(in_round(turn, rounds)).select(F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int").alias("shard"), "_key", "ids")
        kind = "chunk int, part int, n long, w binary"
        learned = dealt.groupBy("shard").applyInPandas(learner(flat, RATES[min(turn, len(RATES) - 1)]), kind)
        level = learned.groupBy("chunk", F.floor(F.col("part") / parts)).applyInPandas(mean, kind)
        got = level.groupBy("chunk").applyInPandas(mean, kind).collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["w"], np.float64) for r in sorted(got, key=lambda r: r["chunk"])]).astype(np.float32)
    return flat


def model_scores(encoded: DataFrame, flat: np.ndarray) -> DataFrame:
    """encoded with model double, the log10 probability of the ids, in their place."""
    weights = encoded.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                model = score(weights.value, [numbers(x) for x in batch["ids"].to_pylist()])[0] / np.log(10)
                names = [c for c in batch.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(model)], names=[*names, "model"])

    return encoded.mapInArrow(run, encoded.drop("ids").select("*", F.lit(0.0).alias("model")).schema)


def evaluate(docs: DataFrame, learn: Column) -> DataFrame:
    """docs(doc_id, text, ...) with n_tokens, n_known, train_tokens, base_score and score in place of the text.

    The documents for which learn holds are learned from: the unigrams count them all, and the recurrent model is trained
    on each once. Words of the head are scored as the text is read; for others the document's distinct words are joined
    to the counts. A word the model does not know has the model's probability of the rest, times the word's share of the
    rest in the unigrams. A null text is empty: it has its end alone. Rows of equal doc_id, and repeated rows, are scored
    apart and alike; an empty table gives no rows; without a document to learn from, all words are equally likely. Columns of docs that have the names of results
    give way to them, others pass through. docs must be a table scan, as rows are numbered.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = docs.drop(*results)
    plain, names = sheltered(kept.withColumn("_learn", learn), "doc_id", "text", "_learn")
    words = cut(counts(plain.where("_learn")), "counts")
    head = Head.of(words)
    rows = plain.withColumns({"_row": F.monotonically_increasing_id(), "_key": F.xxhash64("doc_id", "text")})
    encoded = cut(encode(rows, head), "encoded")
    flat = fit(encoded.where("_learn").select("_key", "ids"), head)
    tail = encoded.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", "t.n")
    c = F.coalesce("c", F.lit(0))
    joined = tail.join(words.where(F.octet_length("word") > 0).withColumnRenamed("n", "c"), "word", "left")
    sums = joined.groupBy("_row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("t_known"), F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(head.whole))).alias("t_base"))
    t_base, t_known = F.coalesce("t_base", F.lit(0.0)), F.coalesce("t_known", F.lit(0))
    scored = model_scores(encoded.drop("tail"), flat)
    return scored.join(sums, "_row", "left").select(
        *(F.col(names[c]).alias(c) for c in kept.columns if c != "text"),
        "n_tokens",
        (F.col("head_known") + t_known).alias("n_known"),
        F.lit(int(head.total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + t_base).alias("base_score"),
        (F.col("model") + F.col("rest_base") + t_base - F.col("rest_tokens") * F.lit(float(np.log10(head.rest)))).alias("score"),
    )


def op9_grulm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log-probabilities of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (~training()).alias("held_out"), "text")
    return evaluate(docs, ~F.col("held_out"))
