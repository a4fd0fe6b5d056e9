import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import common, language, quality, toxicity

from .samples import AWKWARD, docs, prose

BAD = ["moron", "stupid", "trash", "loser"]


def labelled(spark, make, n=300, label="toxic"):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(100, 100 + n):
        y = r.randrange(2)
        rows.append((i, make(r, y)))
        labels.append((i, y))
    ids = [(1, 1), (2, 0), (None, 1), (9, 1), (9, 0), (8, None)]
    return docs(spark, [*AWKWARD, *rows]), spark.createDataFrame(labels + ids, f"doc_id long, {label} int"), dict(labels)


def toxic_text(r, y):
    words = prose(60, r.random()).split()
    for _ in range(3 * y):
        w = r.choice(BAD)
        words.insert(r.randrange(len(words)), w if r.random() < 0.5 else w[:-1] + w[-1] * 2)
    return " ".join(words)


def good_text(r, y):
    return prose(80, r.random()).capitalize() + "." if y else " ".join(w.upper() + r.choice(["!!", "###", "$$"]) for w in prose(80, r.random()).split())


def accuracy(got, truth, mod, rest):
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % mod == rest]
    assert all(r.held_out for r in held) and len(held) > 20
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_toxicity(spark):
    d, labels, truth = labelled(spark, toxic_text)
    got = toxicity.scores(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert accuracy(got, truth, 5, 0) > 0.9
    same = [r.score for r in got if r.doc_id == 9]
    assert same[0] == same[1]


def everything(spark, texts, label):
    """Documents with ids from 0, and their labels."""
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    return docs(spark, rows), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], f"doc_id long, {label} int")


def toxic_model(spark):
    r = random.Random(2)
    return toxicity.fitted(*everything(spark, [(toxic_text(r, y), y) for y in [0, 1] * 150], "toxic"), F.lit(True))


def test_misspelt_words_share_units(spark):
    clean = prose(30, 9)
    low, high = toxic_model(spark).score([clean, clean + " moronns " + clean])
    assert high > low


def plain_toxicity(model, text):
    """The score of one text word by word, without slices or arrays of units."""
    words = []
    for w in re.findall(rb"[a-z0-9'\x80-\xff]+", (text or "").lower().encode()):
        if not words or words[-1] != w:
            words.append(w)
    values = []
    for w in words:
        grams = [b" " + w + b" "] + [(b" " + w + b" ")[i : i + n] for n in toxicity.GRAMS for i in range(len(w) + 3 - n)]
        buf = np.frombuffer(b" ".join(grams), np.uint8)
        end = np.cumsum([len(g) + 1 for g in grams]) - 1
        start = end - [len(g) for g in grams]
        values.append(np.mean([model.value[int(h >> np.uint64(64 - toxicity.BUCKET_BITS))] for h in toxicity.common.range_hash(toxicity.common.prefix_hash(buf), start, end)]))
    means, at = [], 0
    while at < len(values):
        end = at + toxicity.WIDTH
        end = len(values) if len(values) - end < toxicity.WIDTH // 2 else end
        means.append(np.mean(values[at:end]))
        at = end
    z = np.array([np.mean(values) if values else 0.0, max(means, default=0.0)]) + model.bias
    return 1 / (1 + np.exp(-(z @ np.array(model.slopes) + model.shift)))


def test_toxicity_against_word_by_word(spark):
    model = toxic_model(spark)
    r = random.Random(8)
    texts = [None, "", "...", "one", "moron moron moron", prose(31, 1), prose(95, 2), prose(96, 3), toxic_text(r, 1), "Ünï Stüpid ñ 日本語", prose(900, 5) + " stupid trash loser"]
    assert np.allclose(model.score(texts), [plain_toxicity(model, t) for t in texts], atol=1e-9)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_toxicity_of_held_out_documents(spark):
    """Of the held-out toxic documents about one in twenty has a wrong label."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(d, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    p = {r.toxic: r.p for r in got}
    assert p[1] >= 0.94 and p[0] <= 0.03


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_sample_is_of_usable_documents(spark, label):
    """Labels without documents, repeated ids and long texts take no place."""
    d = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 3) || id AS text").unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text")).unionByName(spark.range(400, 500).selectExpr("id AS doc_id", "repeat('long ', 300) AS text"))
    labels = spark.range(20_000).selectExpr("id AS doc_id", f"int(id % 2) AS {label}")
    got = common.labelled_sample(d, labels, label, F.lit(True), 150, 1000)
    assert {(r.y, r["count"]) for r in got.groupBy("y").count().collect()} == {(0, 150), (1, 150)}
    assert got.groupBy("k").count().where("count > 1").count() == 0
    everyone = common.labelled_sample(d, labels, label, F.lit(True), 1000, 1000)
    assert everyone.count() == 400


def plain_pool(text, known, vectors):
    """Mean and spread of token vectors, one token after another."""
    rows, seen, again = [], [], 0
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\t-\r ]+", (text or "").encode()):
        _, h, shape = quality.tokens([m[0]])
        at = np.flatnonzero(known == h[0])
        rows.append(vectors[at[0] if len(at) else len(known) + shape[0]].astype(float))
        again += m[0].lower() in seen[-2:]
        seen.append(m[0].lower())
    if not rows:
        return np.zeros(2 * quality.DIM + 2)
    x = np.stack(rows)
    return np.concatenate([x.mean(0), x.std(0), [np.log1p(len(x)), again / len(x)]])


def test_quality_against_token_by_token(spark):
    texts = [(good_text(random.Random(k), k % 2), k % 2) for k in range(60)]
    model = quality.fit(*everything(spark, texts, "quality"), F.lit(True))
    some = [None, "", "  ", texts[0][0], texts[1][0], "A B a b A b 12 12 ###", prose(300, 1)]
    want = np.stack([plain_pool(t, model.known, model.vectors) for t in some])
    assert np.allclose(model.pooled(some), want, atol=1e-4)
    z = np.tanh((want - model.mean) / model.scale @ model.layers[0] + model.layers[1]) @ model.layers[2] + model.layers[3]
    assert np.allclose(model.score(some), 1 / (1 + np.exp(-z / model.temperature)), atol=1e-3)


def test_word_vectors_against_neighbour_loops(spark):
    sample = spark.createDataFrame([(k, 0, t) for k, t in enumerate(["a b c a", "b a", "", "c c b"])], "k long, y int, text string")
    known = np.sort(np.unique(quality.tokens([b"a b"])[1]))
    got = quality.word_vectors(sample, known)
    index, want = quality.index_of(known), np.zeros_like(got)
    for t in ("a b c a", "b a", "c c b"):
        _, h, shape = quality.tokens([t.encode()])
        ids = quality.lookup(known, h, shape)
        for i in range(len(ids)):
            for j in range(len(ids)):
                if 0 < abs(i - j) <= quality.REACH:
                    want[ids[i]] += index[ids[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    assert np.allclose(got, want + index / quality.NONZERO**0.5, atol=1e-5)


def test_quality(spark):
    d, labels, truth = labelled(spark, good_text, label="quality")
    got = quality.scores(d, labels).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    assert accuracy(got, truth, 3, 1) > 0.9
    kept = quality.accepted(d, labels)
    assert kept.columns == d.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_pooling_ignores_slices(spark, monkeypatch):
    texts = [prose(500, 3), "", None, prose(30, 4)]
    model = quality.fit(*everything(spark, [(good_text(random.Random(k), k % 2), k % 2) for k in range(60)], "quality"), F.lit(True))
    whole = model.pooled(texts)
    monkeypatch.setattr(quality.common, "SLICE_BYTES", 64)
    assert np.allclose(whole, model.pooled(texts), atol=1e-5)


@pytest.mark.parametrize("score", [toxicity.scores, quality.scores])
def test_nothing_to_learn_and_nothing_to_score(spark, score):
    name = "toxic" if score is toxicity.scores else "quality"
    labels = spark.createDataFrame([], f"doc_id long, {name} int")
    d = docs(spark, AWKWARD)
    assert {r.score for r in score(d, labels).collect()} == {0.0 if name == "toxic" else 1.0}
    assert score(d.where("false"), labels).count() == 0


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "xyz wqk zzyx kwq vvk qzx".split()}


def test_language(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(LANGS[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60, 100)]
    awkward = [(i, t, lang) for (i, t), lang in zip(AWKWARD, [None, "aa"] * 6, strict=False) if t is None or len(t) < 100]
    d = docs(spark, rows + awkward)
    got = language.identify(d).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 5)) for r in got)
    assert {r.held_out for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}


def plain_bundle(text):
    """Trigrams of one text, one after another."""
    low = [c if c.isalpha() else " " for c in (text or "").lower()]
    low = [" ", *low, " "]
    out = np.zeros(language.DIM)
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        if b != " ":
            va, vb, vc = language.letter_vectors(np.array([ord(x) for x in (a, b, c)]))
            out += np.roll(va, 2).astype(int) * np.roll(vb, 1) * vc
    return out


def test_language_against_letter_by_letter():
    texts = [None, "", "1 2", "Ab c", "ñandú über alles", prose(40, 1)]
    got, has = language.bundles(texts)
    assert np.allclose(got, [plain_bundle(t) for t in texts]) and has.tolist() == [False, False, False, True, True, True]


def test_many_languages_and_long_ones(spark):
    """300 languages, one of which has long texts only, and unusable rows first."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * 7 + j * (k + 3)) % 26] for j in range(6)) + letters[k % 26] + letters[k // 26]
    rows = [(k * 10 + j, " ".join([word(k)] * (3000 if k == 5 else 5)), f"l{k:03}") for k in range(300) for j in range(4)]
    rows += [(10_000 + j, "123", "l007") for j in range(300)]
    d = docs(spark, rows)
    names, proto = language.prototypes(d, F.lit(True), 400, 1000)
    assert len(names) == 300 and proto.shape == (300, language.DIM)
    got = language.identify(d, per_lang=400, max_chars=1000).where("doc_id < 10000")
    assert got.join(d.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count() >= 1150


def test_language_without_learning(spark):
    d = docs(spark, AWKWARD)
    from pyspark.sql import functions as F

    got = language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify(d.where("false")).count() == 0
