"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector drawn from its code point. A trigram
is the product of its letters' vectors, the first permuted twice and the second
once; a document is the bundle (sum) of its trigrams' vectors, and a language
prototype the bundle of its training documents. A document takes the language
whose prototype has the highest cosine with it, after the mean of the
prototypes, which is what all languages share, is taken out of the prototypes.

The prototypes are fitted on a sample of each language: documents that have a
letter and at most ``max_chars`` characters, drawn by a hash of their id so that
``per_lang`` are expected, or all if there are fewer; a language without such a
document learns from its longer ones. All languages are learned. Prototypes are
bundled on the executors; the driver gets one vector for each language, and the
model grows with the number of languages only. Every text is predicted whole.

Defined cases: texts that are null or have no letter get ``und`` and score 0,
as does everything if there is nothing to learn from. Equal cosines go to the
first language in alphabetical order. Repeated rows are predicted each. Columns
other than doc_id, text and (for learning) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

DIM = 512
STEPS = 1 << 20  # sums are taken in these steps of 1, so that their order does not matter
HELD = 256  # languages a task sums at once
_state: dict = {}


def _letters() -> np.ndarray:
    if "alpha" not in _state:
        _state["alpha"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _state["alpha"]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One bipolar row for each code point, the same everywhere."""
    seeds = common.mix(codes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(1))
    bits = np.unpackbits(seeds.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) * 2 - 1).reshape(len(codes), DIM)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of packed trigrams (21 bits a letter)."""
    cs = [(grams >> s) & 0x1FFFFF for s in (42, 21, 0)]
    codes, at = np.unique(np.concatenate(cs), return_inverse=True)
    v = letter_vectors(codes)
    a, b, c = np.split(at, 3)
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors, and whether a text has a letter."""
    out, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    alpha = _letters()
    for who, part in common.slices([(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts], b""):
        codes = [np.frombuffer(p, "<u4") for p in part]
        all_ = np.concatenate([np.append(c, 32) for c in codes]).astype(np.int64)
        all_ = np.concatenate(([32], all_))
        doc = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
        is_letter = alpha[all_]
        all_[~is_letter] = 32
        has[np.array(who)[np.unique(doc[is_letter[1:]])]] = True
        gram = (all_[:-2] << 42) | (all_[1:-1] << 21) | all_[2:]
        ok = is_letter[1:-1]  # the middle is a letter: one boundary on a side at most
        gram, owner = gram[ok], doc[: len(all_) - 2][ok]
        if not len(gram):
            continue
        kinds, which = np.unique(gram, return_inverse=True)
        cell, count = np.unique(owner * len(kinds) + which, return_counts=True)
        d, k = np.divmod(cell, len(kinds))
        v = gram_vectors(kinds).astype(np.float32)
        first = np.flatnonzero(np.diff(np.concatenate(([-1], d))))
        for lo, hi in zip(first, [*first[1:], len(d)], strict=True):
            out[who[d[lo]]] += count[lo:hi].astype(np.float32) @ v[k[lo:hi]]
    return out, has


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def training_sample(docs: DataFrame, allowed, per_lang: int, max_chars: int) -> DataFrame:
    """(k, lang, text) to learn from, written to the shared folder."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.xxhash64("doc_id").alias("k"), F.col("lang").cast("string").alias("lang"), "text", (F.length("text") <= max_chars).alias("fits")
    )
    # written: Spark then knows its size before it plans the join, and sends it around only where it is small, so texts stay where they are
    sizes = materialize(rows.groupBy("lang").agg(F.sum(F.col("fits").cast("long")).alias("n_fit"), F.count("*").alias("n")), "languages")
    share = F.lit(float(per_lang)) / F.when(F.col("n_fit") > 0, F.col("n_fit")).otherwise(F.col("n"))
    drawn = rows.join(sizes, "lang").where((F.col("fits") | (F.col("n_fit") == 0)) & (F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) < share * float(1 << 30)))
    return materialize(drawn.select("k", "lang", "text").distinct(), "language-sample")


def prototypes(docs: DataFrame, allowed, per_lang: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Sorted languages and their centred unit prototypes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])
            sums.clear()
            return out

        for b in common.batches_of(batches):
            v, has = bundles(b.column(1).to_pylist())
            steps = np.rint(unit(v) * STEPS).astype(np.int64)
            for lang, x, h in zip(b.column(0).to_pylist(), steps, has, strict=True):
                if h:
                    sums[lang] = sums[lang] + x if lang in sums else x
            if len(sums) > HELD:
                yield flush()
        yield flush()

    def add(key, part):
        return part.iloc[:1][["lang"]].assign(v=[np.sum([np.frombuffer(v, np.int64) for v in part["v"]], 0).tobytes()])

    sample = common.spread_out(training_sample(docs, allowed, per_lang, max_chars)).select("lang", "text")
    # SAMPLE_PARTS tasks sum it, so a group has few rows; the driver gets a row for each language
    got = sample.mapInArrow(run, "lang string, v binary").groupBy("lang").applyInPandas(add, "lang string, v binary").orderBy("lang").toArrow()
    if not got.num_rows:
        return [], np.zeros((0, DIM), np.float32)
    names, sums = zip(*sorted(zip(got["lang"].to_pylist(), got["v"].to_pylist(), strict=True)), strict=True)
    proto = unit(np.stack([np.frombuffer(v, np.int64) for v in sums]).astype(float))
    return list(names), unit(proto - proto.mean(0) if len(names) > 1 else proto).astype(np.float32)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = 400, max_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) by row."""
    r = common.crc_mod(F.col("doc_id"), modulus)
    names, proto = prototypes(docs, r != held, per_lang, max_chars)
    shared = docs.sparkSession.sparkContext.broadcast((names, proto))

    def work(texts: list) -> dict:
        names, proto = shared.value
        v, has = bundles(texts)
        if not names:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))}
        cos = unit(v) @ proto.T
        best = cos.argmax(1)
        return {"lang_pred": [names[b] if h else "und" for b, h in zip(best, has, strict=True)], "score": np.where(has, np.clip(cos.max(1), 0, 1), 0).astype(np.float64)}

    made = common.per_text(docs, ["doc_id"], "lang_pred string, score double", work)
    return made.select("doc_id", F.coalesce(r == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document. The cases are those of the module."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
