"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (with word boundaries) and itself.
The vector of a text is the average of the embeddings of its words' units, and a
linear softmax over it gives the class. Embeddings and softmax are trained
jointly in numpy. A misspelled word shares n-grams with the words that were
learned.

Only units that are clearly more frequent in toxic texts have an embedding (at
most KNOWN, those with most evidence); the others stay at zero, so that ordinary
words of a text neither speak for nor against it. An embedding starts at its
unit's log ratio of frequencies. Training takes each document as a whole and its
most toxic passage of WIDTH words, and stops where the loss on a kept-out fold
is least. The logits of the whole document and of its most toxic passage are
calibrated to one probability on that fold.

The classifier is fitted on at most ``per_class`` labelled documents of each
class of at most ``max_chars`` characters. Executors read their texts; the
driver gets counts of units and, of each document, its known units. Every text
is scored whole.

Defined cases: null, empty and word-less texts get the score of the bias alone.
Null or conflicting labels are not learned from. Without labels of both classes
every score is 0; with labels of both but no unit that marks toxic texts every
score is that of the bias. Repeated rows are scored each. Columns other than
doc_id, text and the labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 64
GRAMS = (3, 4, 5, 6, 7)
BUCKET_BITS = 18
DIM = 8
KNOWN = 1 << 13
FOLDS = 5  # one of them is kept out of the training
GATE = 0.7  # log ratio below which a unit says nothing
PRIOR = 3.0  # occurrences that both classes share before any are seen
MOST_REPEATS = 8  # occurrences of a unit in one document that count

_LETTER = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789'":
    _LETTER[_c] = True
_LETTER[0x80:] = True


def word_units(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword unit of the words [start, end);
    one boundary byte stands on either side of a word."""
    prefix = common.prefix_hash(np.where(_LETTER[buf], buf, np.uint8(32)))
    word, made = [np.arange(len(start))], [common.range_hash(prefix, start - 1, end + 1)]
    for n in GRAMS:
        count = np.maximum(0, end - start + 3 - n)
        who = np.repeat(np.arange(len(start)), count)
        at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + (start - 1)[who]
        word.append(who)
        made.append(common.range_hash(prefix, at, at + n))
    return np.concatenate(word), (np.concatenate(made) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def read_words(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: text number and distinct-word number of each word,
    the hashes of the distinct words, and their units (word, bucket). A word
    that follows itself counts once, so a stutter says no more than the word."""
    buf, text_end = common.joined([b"", *part])
    start, end = common.runs(_LETTER[buf])
    doc = np.searchsorted(text_end, start, "right") - 1
    h = common.range_hash(common.prefix_hash(buf), start, end)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    units = word_units(buf, start[first], end[first])
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (which[1:] != which[:-1])))[: len(doc)]
    return doc[new], which[new], distinct, *units


@dataclass
class Model:
    value: np.ndarray  # of each bucket: embedding times (weights of class 1 - weights of class 0)
    bias: float
    slopes: tuple[float, float] = (1.0, 0.0)  # of the calibration, for document and passage
    shift: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the logit of all its words, and of its most toxic passage."""
        words, total, most = np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        for who, doc, which, distinct, word, bucket in _slices(texts):
            value = word_values(self.value, len(distinct), word, bucket)[which]
            for k, i in enumerate(who):
                lo, hi = np.searchsorted(doc, (k, k + 1))
                if hi > lo:
                    v = value[lo:hi]
                    cut = cuts(len(v))
                    sums = np.add.reduceat(v, cut)
                    words[i] += len(v)
                    total[i] += sums.sum()
                    most[i] = max(most[i], (sums / np.diff([*cut, len(v)])).max())
        return np.stack([total / np.maximum(words, 1), np.where(words > 0, most, 0.0)], 1) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(texts) @ np.array(self.slopes) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slices(texts: list[str | None]):
    """For each slice of the texts: their numbers and what read_words returns."""
    for who, part in common.slices([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]):
        yield who, *read_words(part)


def cuts(n: int) -> np.ndarray:
    """Starts of the passages of n words; a short rest joins the passage before."""
    at = np.arange(0, n, WIDTH)
    return at[:-1] if len(at) > 1 and n - at[-1] < WIDTH // 2 else at


def word_values(value: np.ndarray, n: int, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Mean of the units' values of each of n distinct words."""
    return np.bincount(word, value[bucket], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1)


def kept_out(k: str):
    return F.pmod(F.col(k), F.lit(FOLDS)) == 0


def unit_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each bucket (MOST_REPEATS a document at most) and number
    of words, by class, summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for b in common.batches_of(batches):
            y, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            counts: dict[int, tuple[list, list]] = {}
            for who, doc, which, distinct, word, bucket in _slices(texts):
                for k, i in enumerate(who):
                    lo, hi = np.searchsorted(doc, (k, k + 1))
                    words[y[i]] += hi - lo
                    n = np.bincount(which[lo:hi], minlength=len(distinct))[word]
                    into = counts.setdefault(i, ([], []))
                    into[0].append(bucket[n > 0])
                    into[1].append(n[n > 0])
            for i, (units, times) in counts.items():
                distinct, at = np.unique(np.concatenate(units), return_inverse=True)
                seen[y[i], distinct] += np.minimum(np.bincount(at, np.concatenate(times), minlength=len(distinct)), MOST_REPEATS).astype(np.int64)
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[0, some], words[0])), pa.array(np.append(seen[1, some], words[1]))], names=["bucket", "n0", "n1"])

    made = common.spread_out(sample.where(~kept_out("k"))).select("y", "text").mapInArrow(run, "bucket long, n0 long, n1 long")
    got = made.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2^BUCKET_BITS + 1 rows
    bucket, both = got["bucket"].to_numpy(), np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()])
    seen = np.zeros((2, 1 << BUCKET_BITS))
    seen[:, bucket[bucket >= 0]] = both[:, bucket >= 0]
    return seen, both[:, bucket < 0].sum(1)


def ratios(seen: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How far a bucket's log ratio of frequencies, toxic to clean, passes GATE;
    0 for all but the KNOWN buckets with most evidence."""
    if not (words > 0).all():
        return np.zeros(seen.shape[1])
    share = words / words.sum()
    ratio = np.log((seen[1] + PRIOR * share[1]) / (seen[0] + PRIOR * share[0])) - np.log(share[1] / share[0])
    ratio = np.where(seen[1] > 1, np.maximum(ratio - GATE, 0.0), 0.0)
    least = np.partition(ratio * seen[1], -KNOWN)[-KNOWN]
    return np.where(ratio * seen[1] >= max(least, 1e-12), ratio, 0.0)


def known_units(sample: DataFrame, ratio: np.ndarray) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(k, y, kind, known units, their shares) of each document of the sample,
    as a whole (kind 0) and of its passage with the highest ratio (kind 1). A
    unit's share is what its embedding weighs in the average."""
    known = np.flatnonzero(ratio)
    shared = sample.sparkSession.sparkContext.broadcast((known, ratio))  # 2^BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = shared.value
        number = np.full(len(ratio), -1, np.int32)
        number[known] = np.arange(len(known))
        for b in common.batches_of(batches):
            k, y, texts = (b.column(c).to_pylist() for c in range(3))
            bags, best = [np.zeros(len(known)) for _ in texts], [(-1.0, np.zeros(0, np.int32), np.zeros(0)) for _ in texts]
            length = np.zeros(len(texts))
            for who, doc, which, distinct, word, bucket in _slices(texts):
                n_units = np.bincount(word, minlength=len(distinct))
                value = word_values(ratio, len(distinct), word, bucket)
                mine = number[bucket] >= 0
                pair_word, pair_unit = word[mine], number[bucket[mine]]
                for j, i in enumerate(who):
                    lo, hi = np.searchsorted(doc, (j, j + 1))
                    if hi == lo:
                        continue
                    length[i] += hi - lo
                    times = np.bincount(which[lo:hi], minlength=len(distinct)) / np.maximum(n_units, 1)
                    bags[i] += np.bincount(pair_unit, times[pair_word], minlength=len(known))
                    cut = cuts(hi - lo)
                    wide = np.diff([*cut, hi - lo])
                    z = np.add.reduceat(value[which[lo:hi]], cut) / wide
                    top = int(z.argmax())
                    if z[top] > best[i][0]:
                        part = which[lo + cut[top] : lo + cut[top] + wide[top]]
                        times = np.bincount(part, minlength=len(distinct)) / np.maximum(n_units, 1) / wide[top]
                        bag = np.bincount(pair_unit, times[pair_word], minlength=len(known))
                        best[i] = float(z[top]), np.flatnonzero(bag), bag[np.flatnonzero(bag)]
            rows = []
            for i in range(len(texts)):
                some = np.flatnonzero(bags[i])
                rows += [(k[i], y[i], 0, some, bags[i][some] / max(length[i], 1)), (k[i], y[i], 1, *best[i][1:])]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array([v.tolist() for v in cols[3]], pa.list_(pa.int32())), pa.array([v.tolist() for v in cols[4]], pa.list_(pa.float32()))],
                names=["k", "y", "kind", "units", "shares"],
            )

    got = common.spread_out(sample).select("k", "y", "text").mapInArrow(run, "k long, y int, kind int, units array<int>, shares array<float>").toArrow().combine_chunks()
    shared.destroy()
    lists = [np.split(got[c].combine_chunks().flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(got[c]).to_numpy())[:-1]) if len(got) else [] for c in ("units", "shares")]
    return sorted(zip(got["k"].to_pylist(), got["y"].to_pylist(), got["kind"].to_pylist(), *lists, strict=True), key=lambda r: r[:3])


def train(rows: list, ratio: np.ndarray, epochs: int = 12, seed: int = 7) -> Model:
    """Adagrad on the averaged-embedding softmax, classes of equal weight, from
    embeddings that start at the ratios; the epoch with the least loss on the
    kept-out fold stays."""
    rng = np.random.default_rng(seed)
    known = np.flatnonzero(ratio)
    y = np.array([r[1] for r in rows])
    fold = np.array([r[0] % FOLDS == 0 for r in rows])
    emb = rng.normal(0, 0.02, (len(known), DIM))
    emb[:, 0] = ratio[known]
    soft, bias = np.zeros((DIM, 2)), np.zeros(2)
    soft[0] = -0.5, 0.5
    g_emb, g_soft, g_bias = np.full(len(known), 1e-2), np.full((DIM, 2), 1e-2), np.full(2, 1e-2)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)

    def averages(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        units, share = (np.concatenate([rows[i][c] for i in of]) for c in (3, 4))
        owner = np.repeat(np.arange(len(of)), [len(rows[i][3]) for i in of])
        return np.stack([np.bincount(owner, share * emb[units, d], minlength=len(of)) for d in range(DIM)], 1), owner, units, share

    def loss(of: np.ndarray) -> float:
        z = (averages(of)[0] @ soft + bias) @ np.array([-1.0, 1.0])
        z = z - np.median(z)  # the level is the calibration's business
        return float((weight[of] * np.logaddexp(0, np.where(y[of] == 1, -z, z))).sum() / weight[of].sum())

    def snapshot() -> Model:
        value = np.zeros(len(ratio))
        value[known] = emb @ (soft[:, 1] - soft[:, 0])
        return Model(value, float(bias[1] - bias[0]))

    used, out = np.flatnonzero(~fold), np.flatnonzero(fold)
    out = out if len(set(y[out].tolist())) == 2 else used
    if not len(known) or not len(used):
        return snapshot()
    best = np.inf, snapshot()
    for _ in range(epochs):
        rng.shuffle(used)
        for lo in range(0, len(used), 64):
            of = used[lo : lo + 64]
            x, owner, units, share = averages(of)
            z = x @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.eye(2)[y[of]]) * weight[of, None] / len(of)
            d_soft, d_bias, d_x = x.T @ err, err.sum(0), err @ soft.T
            touched, back = np.unique(units, return_inverse=True)
            g = np.stack([np.bincount(back, share * d_x[owner, d], minlength=len(touched)) for d in range(DIM)], 1)
            g_emb[touched] += (g**2).mean(1)
            emb[touched] -= 0.1 * g / np.sqrt(g_emb[touched])[:, None]
            g_soft += d_soft**2
            g_bias += d_bias**2
            soft -= 0.1 * d_soft / np.sqrt(g_soft)
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
        now = loss(out)
        if now < best[0]:
            best = now, snapshot()
    return best[1]


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 3000) -> tuple[tuple[float, float], float]:
    """Slopes of the two logits, none below 0, and shift, with classes of equal
    weight."""
    mid, scale = z.mean(0), np.where(z.std(0) > 0, z.std(0), 1.0)
    x, w = (z - mid) / scale, np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = np.full(2, 0.5), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30)))
        e = w * (p - y)
        a = np.maximum(a - 1.0 * (e @ x + 1e-3 * a), 0.0)
        b -= 1.0 * e.sum()
    if not a.any():
        a = np.full(2, 1e-3)
    a = a / scale
    return (float(a[0]), float(a[1])), float(b - a @ mid)


def fitted(docs: DataFrame, labels: DataFrame, allowed, per_class: int = 3000, max_chars: int = 20_000) -> Model | None:
    """The model, or None where the labels of one class are missing."""
    sample = common.labelled_sample(docs, labels, "toxic", allowed, per_class, max_chars)
    if sample.select("y").distinct().count() < 2:
        return None
    seen, words = unit_counts(sample)
    ratio = ratios(seen, words)
    model = train(known_units(sample, ratio), ratio)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = common.per_text(common.spread_out(sample), ["k", "y"], "z array<double>", lambda texts: {"z": list(shared.value.logits(texts))}).select("k", "y", "z").toArrow()
    shared.destroy()
    k, y = made["k"].to_numpy(), made["y"].to_numpy()
    z = made["z"].combine_chunks().flatten().to_numpy().reshape(-1, 2)
    order = np.argsort(k, kind="stable")
    fold = order[k[order] % FOLDS == 0]
    fold = fold if len(set(y[fold].tolist())) == 2 else order
    model.slopes, model.shift = calibrate(z[fold], y[fold])
    return model


def scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    r = common.crc_mod(F.col("doc_id"), modulus)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, r != held, **bounds))  # 2^BUCKET_BITS doubles, whatever the data

    def work(texts: list) -> dict:
        s = shared.value.score(texts) if shared.value else np.zeros(len(texts))
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    made = common.per_text(docs, ["doc_id"], "score double, predicted int", work)
    return made.select("doc_id", F.coalesce(r == held, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document. The cases are those of the module."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, labels)
