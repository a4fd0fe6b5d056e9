import itertools
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import common, simhash

from .samples import AWKWARD, docs, prose


def plain_fingerprint(text):
    words, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, links):
    root = {r: r for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {r: find(r) for r in rows}


@pytest.mark.parametrize("text", [t for _, t in AWKWARD if t is None or len(t) < 50000] + ["A b C d E", "a b c", "tab\tand\x0bvt"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_variants_meet_every_close_pair(spark):
    base = 0x0123456789ABCDEF
    for bits in [(0, 1, 2, 3), (0, 20, 21, 63), (5, 6, 41, 42), (60, 61, 62, 63), (21, 22, 42, 43)]:
        other = base
        for b in bits:
            other ^= 1 << b
        signed = [x - (1 << 64) if x >> 63 else x for x in (base, other)]
        v = spark.createDataFrame([(x,) for x in signed], "fp long").select(simhash.variants(F.col("fp"), 4).alias("v")).collect()
        assert set(v[0].v) & set(v[1].v)


def test_components_against_all_pairs(spark):
    import random

    r = random.Random(3)
    fps = []
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            fps.append(f)
            f ^= 1 << r.randrange(64)
            f ^= 1 << r.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    got = {r.fp: r.root for r in simhash.roots(spark.createDataFrame([(x, x) for x in signed], "fp long, root long"), "root", 4).collect()}
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = groups(signed, links)
    by_got, by_want = defaultdict(set), defaultdict(set)
    for x in signed:
        by_got[got[x]].add(x)
        by_want[want[x]].add(x)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    base = 0x00FF00FF00FF00FF
    fps = [base ^ (1 << i) for i in range(40)]
    out = simhash.roots(spark.createDataFrame([(x, x) for x in fps], "fp long, root long"), "root", 4).collect()
    assert len({r.root for r in out}) == 1


def test_documents(spark):
    text = prose(400, 5)
    near = text.replace("fox", "cat", 1)
    rows = [*AWKWARD, (20, text), (21, text.upper()), (22, near), (23, prose(400, 6)), (24, text)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(r.fingerprint == f"{plain_fingerprint(dict(rows)[r.doc_id]):016x}" for r in got if r.doc_id not in (10, None))
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[21].component_id == by_id[24].component_id == 20 and by_id[23].component_id == 23
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert len(ids) == len(set(ids)) == len({r.component_id for r in got})
    assert (True, 0) in ids and (False, 21) not in ids


def test_no_rows(spark):
    empty = docs(spark, AWKWARD).where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_of_a_large_star(spark):
    edges = spark.range(1, 60_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.range(100_000, 100_400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = common.components(edges)
    assert {r.component: r["count"] for r in got.groupBy("component").count().collect()} == {0: 60_000, 100_000: 401}
