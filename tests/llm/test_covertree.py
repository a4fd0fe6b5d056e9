import numpy as np
import pytest

from sessionloom.llm import covertree as C


def plain(rows, cosine=0.95):
    """rows (vec_id, vector) -> [(vec_id, n_links, component_id, kept)]"""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    pairs = []
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    pairs.append((a, b))
                    n[a] += 1
                    n[b] += 1
    for _ in rows:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]]
        c = min(ids) if None not in ids else None
        out.append((k, n[i], c, k is not None and k == c))
    return sorted(out, key=str)


def cloud(n=300, dim=8, seed=0, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = [centres[int(r.integers(12))] + r.normal(size=dim) * spread * r.choice([0.2, 1, 4]) for _ in range(n)]
    return [(int(i) + 10, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


ODD = [(1, None), (2, []), (3, [0.0] * 8), (4, [None] + [1.0] * 7), (5, [float("nan")] + [1.0] * 7), (6, [float("inf")] + [1.0] * 7), (7, [1.0, 0.0]), (8, [2.0, 0.1]), (None, [1.0] * 8), (9, [1e30] * 8), (9, [1e-30] * 8)]


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_against_all_pairs(spark, block):
    rows = cloud() + ODD + [(1000 + i, cloud()[0][1]) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n_links string, cid int")
    got = sorted(map(tuple, C.near_vectors(df, block=block).collect()), key=str)
    assert got == plain([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])


def test_doubles_and_empty(spark):
    rows = cloud(40, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, C.near_vectors(df).collect()), key=str) == plain(rows)
    assert C.near_vectors(df.where("false")).count() == 0


def test_tree_covers_and_halves():
    x = np.random.default_rng(1).normal(size=(400, 6))
    tree = C.Tree(x, np.arange(400), np.ones(400, np.int64))
    assert sorted(tree.ids.tolist()) == list(range(400))
    for k in range(len(tree.centre)):
        span = tree.x[tree.start[k] : tree.end[k]]
        assert tree.start[k] <= tree.centre[k] < tree.end[k]
        assert C.chord(span @ tree.x[tree.centre[k]]).max() <= tree.radius[k] + 1e-7
        if tree.high[k]:
            kids = range(tree.low[k], tree.high[k])
            assert [tree.start[kids[0]], *[tree.end[c] for c in kids]] == [*[tree.start[c] for c in kids], tree.end[k]]
            assert tree.centre[k] in {tree.centre[c] for c in kids}


def test_strips_and_pairs_of_any_size_find_the_same_links(monkeypatch):
    from sessionloom.llm import covertree

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), rng.normal(size=(80, 8))]).astype(np.float32)
    a, b = (covertree.Tree(part, np.arange(len(part)), np.ones(len(part), np.int64)) for part in (x[:60], x[60:]))
    close = a.x @ b.x.T >= 0.95
    for strip, pairs in ((128, 1 << 13), (3, 7), (1, 1)):
        monkeypatch.setattr(covertree, "STRIP", strip)
        monkeypatch.setattr(covertree, "PAIRS", pairs)
        na, nb, _, _ = covertree.dual(a, b, 0.95)
        assert na.tolist() == close.sum(1).tolist() and nb.tolist() == close.sum(0).tolist() and close.any()
    found = np.zeros((5, 9), bool)
    found[[0, 2, 4], [8, 0, 8]] = True
    assert [v.tolist() for v in covertree.true_at(found)] == [[0, 2, 4], [8, 0, 8]]


def test_vectors_without_neighbours_get_no_wide_nodes():
    """Such nodes rule nothing out, and their pairs were opened one by one."""
    x = np.random.default_rng(2).normal(size=(1500, 64))
    x[700:710] = x[700] + 0.02 * np.random.default_rng(3).normal(size=(10, 64))
    tree = C.Tree(x, np.arange(1500), np.ones(1500, np.int64), C.directions(C.unit(x[:500]), 0.95))
    assert tree.radius[1:].max() <= C.TIGHT and (tree.radius[1:] > 0).any()
    groups = np.random.default_rng(4).normal(size=(5, 64))[np.arange(1500) % 5] + 0.03 * x
    assert (C.Tree(groups, np.arange(1500), np.ones(1500, np.int64)).high[0] - 1) == 5


def test_sketches_are_upper_bounds_and_let_few_pairs_pass():
    x = C.unit(np.random.default_rng(6).normal(size=(600, 64)))
    basis = C.directions(x, 0.95)
    s = C.sketch(x, basis)
    assert s.shape[1] < 40 and (s @ s.T >= x @ x.T - C.COARSE / 10).all()
    assert (s @ s.T >= 0.95 - C.COARSE).mean() < 1 / 100
    assert C.directions(C.unit(np.ones((600, 64)) + 2 * x), 0.95) is None  # cosines of about 0.94: no half of the directions tells them apart
    assert C.directions(x[:1], 0.95) is None and C.directions(C.unit(np.ones((3, 1))), 0.95) is None


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_the_links_of_any_kind_of_data(seed, monkeypatch):
    from sessionloom.llm import common

    rng = np.random.default_rng(seed)
    n, d = 500, (5, 32)[seed % 2]
    x = rng.normal(size=(60, d))[rng.integers(60, size=n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 0.3], size=(n, 1))
    if seed > 2:
        x = 2 * rng.normal(size=d) + 0.5 * rng.normal(size=(n, d))
    monkeypatch.setattr(C, "WIDE", (4, 128)[seed % 2])
    monkeypatch.setattr(C, "WIDTH", (37, 1024)[seed % 2])
    basis = (C.directions(C.unit(x), 0.95), np.linalg.qr(rng.normal(size=(d, 2)))[0])[seed % 2]
    weight = rng.integers(1, 4, n)
    a, b = (C.Tree(x[at], at, weight[at], basis) for at in (np.arange(200), np.arange(200, n)))
    na, nb, la, lb = C.dual(a, b, 0.95)
    close = a.x @ b.x.T >= 0.95
    assert na.tolist() == (close @ b.weight).tolist() and nb.tolist() == (a.weight @ close).tolist() and close.any()
    spans = []
    for i, j in ((la, lb), np.nonzero(close)):
        spans.append(common.Forest(n))
        spans[-1].add(i, j + 200)
    assert spans[0].roots().tolist() == spans[1].roots().tolist() and close[la, lb].all()


def test_links_of_two_trees_are_joined_once():
    from sessionloom.llm import common

    forest = common.Forest(1000)
    forest.add(np.zeros(998, np.int64), np.arange(1, 999))
    looked = []

    class Seen(np.ndarray):
        def tolist(self):
            looked.append(len(self))
            return super().tolist()

    i, j = forest.add(np.full(998, 999).view(Seen), np.arange(998).view(Seen))
    assert (list(i), list(j)) == ([999], [0]) and looked == [1, 1]
    i, j = common.Forest(5).add(np.array([4, 4, 3, 2, 4]), np.array([3, 3, 4, 1, 2]))
    assert (i.tolist(), j.tolist()) == ([4, 2, 4], [3, 1, 2])
