import hashlib

import numpy as np
import pytest

from sessionloom.llm import codes as C


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (vec_id, vector, label) -> [(vec_id, code, error, label_error)], digest: entry by entry."""
    kept = [(k, None if v is None else [float(np.float32(x)) if x is not None else None for x in v], label) for k, v, label in rows]
    kept = [(k, [int(np.floor(scale * x)) for x in v], label) for k, v, label in kept if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], None
    first = {}
    for k, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(k, v)
    first = [first[k] for k in sorted(first)][:entries]
    size = len(first[0])
    width = -(-size // parts)
    cut = lambda v: [(v + [0] * (width * parts - size))[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for v in first if len(v) == size] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    vectors = [cut(v) for _, v, _ in kept if len(v) == size]
    for _ in range(rounds):
        got = [[near(p, v[p])[0] for p in range(parts)] for v in vectors]
        for p in range(parts):
            books[p] = [[sum(v[p][i] for v in mine) // len(mine) for i in range(width)] if (mine := [v for v, g in zip(vectors, got, strict=True) if g[p] == k]) else e for k, e in enumerate(books[p])]
    out = []
    for k, v, label in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))] if len(v) == size else None
        out.append([k, found and "".join(f"{i:02x}" for i, _ in found), found and sum(d for _, d in found), label])
    sums = {}
    for r in out:
        sums[r[3]] = r[2] if sums.get(r[3]) is None else sums[r[3]] + (r[2] or 0)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r[:3], sums[r[3]]) for r in out), key=str), digest


def rows(n=400, size=16, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(24, size))
    made = [(int(i) * 3 + 5, (centre[i % 24] + r.normal(size=size) * 0.2).astype(np.float32).tolist(), [None, 0, 1][int(r.integers(3))]) for i in range(n)]
    return [*made, *made[:30], *[(10_000 + i, made[0][1], 7) for i in range(50)]]  # repeated rows, and copies under other ids


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error double").repartition(parts)


ODD = [(1, None, 1), (2, [None] + [1.0] * 15, 1), (3, [float("nan")] * 16, 0), (4, [float("-inf")] * 16, None), (500_000, [1.0, 2.0], 2), (500_001, [], 3), (None, [0.5] * 16, 0), (600, [-1.0] * 16, None)]


@pytest.mark.parametrize("case", [rows(), rows() + ODD, rows(9), rows(60, 13), [(i, [float(i % 3)] * 8, None) for i in range(40)]])
def test_against_every_entry(spark, case):
    want, digest = plain(case)
    got = C.coded(frame(spark, case)).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_other_sizes_and_partitions(spark):
    case = rows(200, 12, 3)
    want, digest = plain(case, 3, 5, 2, 100)
    got = C.coded(frame(spark, case, 9), 3, 5, 2, 100).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert got[0].codebooks_sha256 == digest


def test_nothing_to_learn_from(spark):
    assert C.coded(frame(spark, rows(9)).where("false")).collect() == []
    assert C.coded(frame(spark, ODD[:4])).collect() == []
    assert sorted(map(tuple, C.coded(frame(spark, [(1, [], 1), (2, [], None)])).select("vec_id", "code", "error").collect())) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    alone = C.coded(frame(spark, [(None, [1.0] * 8, 1)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in alone] == [(None, None, None)]


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        C.coded(frame(spark, [(1, [1e30] * 8, 1)])).collect()


def test_restored_is_near(spark):
    case = rows(300)
    length, books = C.fitted(frame(spark, case))
    for r in C.compressed(frame(spark, case), length, books).limit(20).collect():
        v = np.floor(np.array(next(v for k, v, _ in case if k == r.vec_id)) * 4096)
        assert int(((v - C.restored(r.code, books)) ** 2).sum()) == r.error


def test_partial_distances_drop_nothing():
    r = np.random.default_rng(2)
    x, book = r.integers(-3, 4, (2000, 8)), r.integers(-3, 4, (16, 8))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    index, best = C.nearest(x, book)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
