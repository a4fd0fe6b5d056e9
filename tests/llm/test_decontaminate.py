import hashlib
import re

from pyspark.sql import functions as F

from sessionloom.llm import decontaminate as D

from .samples import AWKWARD, docs, prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= {i for i in wins[tuple(w[k : k + n])] if i is not None}
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, prose(30, 50)), (2, prose(14, 51)), (3, "short Item of five words"), (4, None), (5, "..."), (6, prose(30, 50)), (11, prose(200, 52)), (None, prose(20, 53))]
ROWS = [
    *AWKWARD,
    (20, prose(300, 60) + " " + prose(30, 50) + " " + prose(300, 61)),
    (21, prose(30, 50).upper()),
    (22, prose(5, 62) + " short-item OF five, words " + prose(400, 63)),
    (23, " ".join(prose(200, 52).split()[50:63])),
    (24, " ".join(prose(200, 52).split()[50:62])),
    (25, prose(20, 53)),
    (26, prose(14, 51) + " " + prose(14, 51)),
]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(df):
    return sorted(map(tuple, D.report(df).collect()), key=str)


def test_against_all_windows(spark):
    assert found(D.contamination(docs(spark, ROWS), items(spark))) == plain(ROWS, ITEMS)


def test_blocks_of_items_give_the_same(spark):
    assert found(D.contamination(docs(spark, ROWS), items(spark), block_words=10)) == plain(ROWS, ITEMS)


def test_clean_keeps_the_rest_as_it_is(spark):
    kept = D.clean(docs(spark, ROWS), items(spark))
    bad = {r[0] for r in plain(ROWS, ITEMS) if r[5]}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs(spark, ROWS).collect() if r.doc_id not in bad)


def test_proximity(spark):
    index = D.build_index(docs(spark, [(1, "a b c d e a"), (2, "a x x x b"), (3, "b a"), (4, None)]))
    near = {tuple(r) for r in D.proximity(index, "a", "b", 2).collect()}
    assert near == {(1, 0), (3, 1)}
    assert {tuple(r) for r in D.proximity(index, "a", "a", 5).collect()} == {(1, 0), (1, 5)}


def test_empty_tables(spark):
    assert D.contamination(docs(spark, ROWS).where("false"), items(spark)).count() == 0
    none = D.report(D.contamination(docs(spark, ROWS), items(spark).where("false"))).collect()
    assert len(none) == len(ROWS) and not any(r.contaminated for r in none)


def test_words_that_differ_only_in_their_pattern(spark):
    """Thue-Morse words, whose polynomial hashes modulo a power of two are equal."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert D.text_terms(a)[0] != D.text_terms(b)[0]
    one = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert [(r.doc_id, r.n_hit) for r in D.report(D.contamination(docs(spark, [(1, a), (2, b)]), one)).orderBy("doc_id").collect()] == [(1, 1), (2, 0)]


def test_equal_items_are_read_once(spark):
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("item_id"), F.lit(prose(30, 50)).alias("text"))
    want = plain(ROWS, [(1, prose(30, 50))])
    assert found(D.contamination(docs(spark, ROWS), many, block_words=100_000)) == want
