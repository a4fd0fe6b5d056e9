"""Document quality from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, of digits and of other signs; a word that the
fitting sample has too rarely stands for its shape (case, length). Each token
type has a fixed sparse random index vector, and its word vector is the sum of
the index vectors of its neighbours. A document is the mean and the spread of
the word vectors of its tokens, its length, and the share of its tokens that
repeat one of the two before; a network with one hidden layer, trained in
numpy, gives a logit, and a temperature fitted on rows kept out of the training
turns it into a probability.

Word vectors and network are fitted on at most ``per_class`` labelled documents
of each class of at most ``max_chars`` characters. Executors count their words,
sum the word vectors and pool the documents; the driver gets the vocabulary, its
vectors and one row of numbers for each document, and trains the network. Every
text is scored whole.

Defined cases: null, empty and blank texts pool to the zero vector and are
scored as that. Null or conflicting labels are not learned from. Without labels
of both classes every score is 1 (nothing is known to be bad). Repeated rows
are scored each. Columns other than doc_id, text and labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 64
NONZERO = 4
REACH = 2
VOCABULARY = 20_000
LEAST_SEEN = 5
CHUNK = 1024  # word vectors that travel as one row
SHAPES = 48
ONES = np.ones(4096, np.float32)

_KIND = np.full(256, 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 sign
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def tokens(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and shape of each token of a slice."""
    buf, text_end = common.joined(part)
    kind = _KIND[buf]
    start = np.flatnonzero(np.diff(np.concatenate(([0], kind))) != 0)
    start = start[kind[start] > 0] if len(start) else start
    change = np.append(np.flatnonzero(np.diff(kind) != 0) + 1, len(buf))
    end = change[np.searchsorted(change, start, "right")]
    length, upper = end - start, np.concatenate(([0], np.cumsum(_UPPER[buf])))
    caps = upper[end] - upper[start]
    case = np.where(caps == 0, 0, np.where((caps * 2 > length) & (length > 1), 2, 1))
    shape = (kind[start] - 1) * 16 + case * 5 + np.minimum(length // 3, 4)
    return np.searchsorted(text_end, start, "right"), common.range_hash(common.prefix_hash(_LOW[buf]), start, end), shape.astype(np.int64)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors, drawn from the token's own hash."""
    out = np.zeros((len(hashes), DIM), np.float32)
    h = hashes
    for _ in range(NONZERO):
        h = common.mix(h + np.uint64(0x9E3779B97F4A7C15))
        out[np.arange(len(h)), (h % np.uint64(DIM)).astype(int)] += np.where(h >> np.uint64(63), 1, -1)
    return out


@dataclass
class Model:
    known: np.ndarray  # sorted hashes
    vectors: np.ndarray  # of the known words, then of the shapes
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def ids(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return lookup(self.known, h, shape)

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        return pool(texts, self.known, self.vectors)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -30, 30)))


def lookup(known: np.ndarray, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
    if not len(known):
        return shape
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[k] == h, k, len(known) + shape)


def pool(texts: list[str | None], known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors, log(1 + tokens) and the
    share of tokens that repeat one of the two before."""
    n, again = np.zeros(len(texts)), np.zeros(len(texts))
    going, before = None, np.zeros(0, np.uint64)
    total, square = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM))
    for who, part in common.slices([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        doc, h, shape = tokens(part)
        if not len(doc):
            continue
        ids = lookup(known, h, shape)
        if len(who) > 1 or who[0] != going:  # else a further piece of the same text
            going, before = who[0] if len(who) == 1 else None, h[:0]
        past, owner = np.concatenate((before, h)), np.concatenate((doc[:1].repeat(len(before)), doc))
        same = np.zeros(len(past), bool)
        for step in (1, 2):
            same[step:] |= (past[step:] == past[:-step]) & (owner[step:] == owner[:-step])
        same, before = same[len(before) :], past[-2:]
        repeats = np.bincount(doc[same], minlength=len(who))
        first = np.flatnonzero(np.diff(np.concatenate(([-1], doc))))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
            i = who[doc[lo]]
            n[i] += hi - lo
            again[i] += repeats[doc[lo]]
            for at in range(lo, hi, 4096):
                v = vectors[ids[at : min(hi, at + 4096)]]
                total[i] += ONES[: len(v)] @ v
                square[i] += np.einsum("nd,nd->d", v, v)
    m = total / np.maximum(n, 1)[:, None]
    sd = np.sqrt(np.maximum(square / np.maximum(n, 1)[:, None] - m * m, 0))
    return np.concatenate([m, sd, np.log1p(n)[:, None], (again / np.maximum(n, 1))[:, None]], 1)


def vocabulary(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the VOCABULARY most frequent words of the sample that
    occur LEAST_SEEN times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in common.texts_of(batches):
            for _, part in common.slices(texts):
                h, n = np.unique(tokens(part)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = common.spread_out(sample).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "h").limit(VOCABULARY)
    return np.sort(np.array(often.select("h").toArrow()["h"].to_numpy()).view(np.uint64))


def word_vectors(sample: DataFrame, known: np.ndarray) -> np.ndarray:
    """Vectors of the known words, then of the shapes: the sum of the index
    vectors of a word's neighbours, at unit length, and its own index vector."""
    size = len(known) + SHAPES
    shared = sample.sparkSession.sparkContext.broadcast(known)  # VOCABULARY at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        index, total = index_of(known), np.zeros((size, DIM), np.float32)
        for texts in common.texts_of(batches):
            for _, part in common.slices(texts):
                doc, h, shape = tokens(part)
                ids = lookup(known, h, shape)
                for step in range(1, min(REACH, len(ids) - 1) + 1):
                    ok = doc[step:] == doc[:-step]
                    a, b = ids[:-step][ok], ids[step:][ok]
                    for d in range(DIM):
                        total[:, d] += np.bincount(a, index[b, d], minlength=size) + np.bincount(b, index[a, d], minlength=size)
        for at in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + CHUNK].tobytes()])], names=["at", "sums"])

    def add(key, part):
        return part.iloc[:1][["at"]].assign(sums=[np.sum([np.frombuffer(v, np.float32) for v in part["sums"]], 0).astype(np.float32).tobytes()])

    # a group has a chunk of SAMPLE_PARTS tasks
    sums = common.spread_out(sample).select("text").mapInArrow(run, "at long, sums binary").groupBy("at").applyInPandas(add, "at long, sums binary").toArrow()
    shared.destroy()
    vectors = np.zeros((size, DIM), np.float32)
    for at, data in zip(sums["at"].to_pylist(), sums["sums"].to_pylist(), strict=True):
        vectors[at : at + CHUNK] = np.frombuffer(data, np.float32).reshape(-1, DIM)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    return vectors + index_of(known) / np.float32(NONZERO**0.5)  # a word counts as itself as well as by its company


def index_of(known: np.ndarray) -> np.ndarray:
    return index_vectors(np.concatenate([known, common.mix(np.arange(1, SHAPES + 1, dtype=np.uint64))]))


def pooled_sample(sample: DataFrame, known: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled documents and their labels, in the order of the sample's hash."""
    shared = sample.sparkSession.sparkContext.broadcast((known, vectors))
    made = common.per_text(common.spread_out(sample), ["k", "y"], "x array<double>", lambda texts: {"x": list(pool(texts, *shared.value))}).select("k", "y", "x").toArrow()
    shared.destroy()
    order = np.argsort(made["k"].to_numpy(), kind="stable")
    x = made["x"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)
    return x[order], made["y"].to_numpy()[order].astype(float)


def train(x: np.ndarray, y: np.ndarray, known: np.ndarray, vectors: np.ndarray, hidden: int = 24, epochs: int = 120, seed: int = 11) -> Model:
    """Adam on the two-layer network over the pooled documents."""
    model = Model(known, vectors, (np.zeros(0),) * 3 + (0.0,), x.mean(0), x.std(0) + 1e-6)
    x = (x - model.mean) / model.scale
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    w = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m1, m2, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        rng.shuffle(used)
        for lo in range(0, len(used), 128):
            i = used[lo : lo + 128]
            a = np.tanh(x[i] @ p[0] + p[1])
            z = a @ p[2] + p[3]
            e = w[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [x[i].T @ back + 1e-4 * p[0], back.sum(0), a.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    model.layers = (p[0], p[1], p[2], float(p[3][0]))
    z = np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda temp: np.mean(w[held] * np.logaddexp(0, np.where(y[held] == 1, -z, z) / temp)) if len(held) else temp
    model.temperature = float(min(np.exp(np.linspace(-1.5, 3, 46)), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed, per_class: int = 3000, max_chars: int = 20_000) -> Model | None:
    """The model, or None where the labels of one class are missing."""
    sample = common.labelled_sample(docs, labels, "quality", allowed, per_class, max_chars)
    if sample.select("y").distinct().count() < 2:
        return None
    known = vocabulary(sample)
    vectors = word_vectors(sample, known)
    return train(*pooled_sample(sample, known, vectors), known, vectors)


def fitted(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **bounds):
    """A function from texts to probabilities of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, common.crc_mod(F.col("doc_id"), modulus) != held, **bounds))  # at most VOCABULARY + SHAPES vectors
    return lambda texts: shared.value.score(texts) if shared.value else np.ones(len(texts))


def scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    score = fitted(docs, labels, modulus, held, **bounds)

    def work(texts: list) -> dict:
        s = score(texts)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    made = common.per_text(docs, ["doc_id"], "score double, predicted int", work)
    return made.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """The documents whose score is at least ``least``, as they are."""
    score = fitted(docs, labels, **bounds)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    made = common.per_text(rows, ["row"], "score double", lambda texts: {"score": score(texts)}, "row.text")
    return common.unwrapped(made.where(F.col("score") >= least), docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document. The cases are those of the module."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, labels)
