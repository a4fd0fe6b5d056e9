"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of
cover trees.

Equal vectors (by a 128-bit hash) collapse into weighted classes. Classes are
dealt to cells around pivots, cells that are too large to cells around pivots of
their own, and each cell is a block of about BLOCK_BYTES (cut by a hash only
where that does not help). Each block gets a cover tree: nested levels of centres
whose radii halve, every node with its covering radius. Two blocks whose cells
can hold a link meet in one task, which walks both trees at once: a node pair
farther apart than threshold plus covering radii is dropped, one that lies wholly
within the threshold is counted at once, others are opened. The result is exact;
a task returns counts by class and a spanning forest of its links, never all
pairs.

Vectors without neighbours in a high dimension leave little to prune: such a tree
has wide nodes only where they hold many points each, else its points and tight
nodes lie right under the root, and the walk ends as a blocked product of the two
blocks. That product is one of sketches: the coordinates along a few principal
directions and the length of what is left, so that the product of two sketches
is never below the cosine. Only pairs that pass it are computed in full. The
directions come from at most SAMPLE rows and bear on time alone: the bound holds
for any. The number of block pairs is quadratic in that case, as for every exact
method of this kind; a block travels once for each block it meets.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, link with nothing; such a row is its own
component. Vectors of different lengths never link (one pass for each length).
Repeated rows are vectors of their own and link with each other; rows that share
a vec_id share the smallest component_id as far as links make them. Only vec_id
and the vector are read, so further columns do not matter. No rows give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

RADII = (0.5, 0.25, 0.125, 0.0625)  # wider nodes rule nothing out
TIGHT = 0.125  # a level of wider nodes is made only where they hold WIDE points each
WIDE = 128
BLOCK_BYTES = 8 << 20  # of unit vectors in a block
LEAST_BLOCKS = 5  # so that some tasks share even small tables
CELLS = 1024  # pivots of the first level
SUBCELLS = 64  # of a cell that is too large
SLACK = 1e-6
MOST_TASKS = 4096
COARSE = 1e-4
STRIP, WIDTH, PAIRS = 128, 1024, 1 << 13  # rows and columns of a product, and node pairs, that are looked at together: they stay in a core's cache
DENSE = 64  # a product with more than one pair in so many left is computed in full
BLOCKED = 1024  # node pairs of one node from which they are a product
SAMPLE = 1024  # rows that the directions of sketches are taken from


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chord(dot):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def sketch(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Rows whose products are upper bounds of those of the unit vectors x:
    coordinates along the orthonormal columns of basis, and the length of the rest."""
    if basis is None:
        return x.astype(np.float32)
    along = x @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", along, along)))
    return np.column_stack((along, rest)).astype(np.float32)


def directions(x: np.ndarray, cosine: float) -> np.ndarray | None:
    """The fewest principal directions of x whose sketches let few of its pairs
    below cosine pass; None where not even half of all directions do."""
    axes, far, k = np.linalg.svd(x, full_matrices=False)[2].T, x @ x.T < cosine, 7
    while 2 * (k + 1) <= x.shape[1] and k <= axes.shape[1]:
        s = sketch(x, axes[:, :k])
        if (far & (s @ s.T >= cosine - COARSE)).mean() <= 1 / 256:
            return axes[:, :k].copy()
        k = 2 * k + 1
    return None


def true_at(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, which are few: faster than over two axes."""
    k = np.flatnonzero(found)
    return k // found.shape[1], k % found.shape[1]


def near(left: np.ndarray, right: np.ndarray, x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in p and q, and product, of all pairs of rows x[p] and y[q] whose
    product is at least ``least`` (and of some below). left and right are their
    sketches, in single precision, whose error is below COARSE."""
    found = left @ right.T >= np.float32(least - COARSE)
    if np.count_nonzero(found) * DENSE > found.size:
        full = x[p] @ y[q].T
        k, m = true_at(full >= least - SLACK)
        return k, m, full[k, m]
    k, m = true_at(found)
    return k, m, np.einsum("nd,nd->n", x[p[k]], y[q[m]])


def net(x: np.ndarray, s: np.ndarray, first: int, radius: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres (``first`` among them) that cover all rows of x (sketches s) within
    radius, and the nearest centre's number for each row; None if that takes more
    than ``most`` centres."""
    least, centres = 1.0 - radius * radius / 2.0, [first]
    held, n = np.empty_like(s), 0  # the centres' sketches, gathered once

    def meet(here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in here and numbers of centres near each other, and product."""
        found = [(at, near(s[here], held[at : min(n, at + WIDTH)], x, here, x, so_far[at : at + WIDTH], least)) for at in range(0, n, WIDTH)]
        return tuple(np.concatenate(v) for v in zip(*((k, m + at, dot) for at, (k, m, dot) in found), strict=True))

    for lo in range(0, len(x), STRIP):
        held[n : len(centres)], n = s[centres[n:]], len(centres)
        so_far = np.array(centres)
        here = np.arange(lo, min(len(x), lo + STRIP))
        k, _, dot = meet(here)
        free = np.ones(len(here), bool)
        free[k[dot >= least]] = False
        open_ = here[free]
        if len(open_):
            close = x[open_] @ x[open_].T >= least
            covered = np.zeros(len(open_), bool)
            for k in range(len(open_)):
                if not covered[k]:
                    centres.append(int(open_[k]))
                    covered |= close[k]
        if len(centres) > most:
            return None
    held[n : len(centres)], n = s[centres[n:]], len(centres)
    so_far = np.array(centres)
    owner = np.full(len(x), -1)
    owner[so_far] = np.arange(n)
    others = np.flatnonzero(owner < 0)
    owner[others] = 0
    for lo in range(0, len(others), STRIP):
        here = others[lo : lo + STRIP]
        k, m, dot = meet(here)
        by = np.argsort(dot, kind="stable")  # of several values for a row the last stays: the nearest
        owner[here[k[by]]] = m[by]
    return so_far, owner


class Tree:
    """Points in depth-first order; node k covers points start[k]:end[k] within
    radius[k] of point centre[k]; its children are nodes low[k]:high[k]."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, weight: np.ndarray, basis: np.ndarray | None = None):
        x = unit(vectors)
        s = sketch(x, basis)
        self.centre, self.start, self.end, self.radius, self.low, self.high = [0], [0], [len(x)], [0.0], [0], [0]
        order: list[int] = []
        todo = [(0, np.arange(len(x)), 0, 0)]  # node, points, centre, level; last in, first out keeps depth-first order
        while todo:
            node, points, centre, level = todo.pop()
            self.start[node], self.end[node] = len(order), len(order) + len(points)
            self.centre[node] = centre
            self.radius[node] = float(chord((x[points] @ x[centre]).min())) if len(points) > 1 else 0.0
            if len(points) == 1:
                order.append(int(points[0]))
                continue
            while True:
                if level == len(RADII):
                    centres, owner = points, np.arange(len(points))
                    break
                most = len(points) if RADII[level] <= TIGHT else len(points) // WIDE
                found = net(x[points], s[points], int(np.flatnonzero(points == centre)[0]), RADII[level], most) if most > 1 else None
                level += 1
                if found is not None and len(found[0]) > 1:
                    centres, owner = points[found[0]], found[1]
                    break
            first = len(self.centre)
            self.low[node], self.high[node] = first, first + len(centres)
            for field in (self.centre, self.start, self.end, self.low, self.high):
                field.extend([0] * len(centres))
            self.radius.extend([0.0] * len(centres))
            by = np.argsort(owner, kind="stable")
            groups = np.split(points[by], np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
            todo.extend((first + k, groups[k], int(centres[k]), level) for k in range(len(centres) - 1, -1, -1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.vectors, self.x, self.ids, self.weight = vectors[order], x[order], ids[order], weight[order]
        self.basis, self.sketch = basis, s[order]
        self.centre = place[np.array(self.centre)]
        self.start, self.end, self.low, self.high = (np.array(v) for v in (self.start, self.end, self.low, self.high))
        self.radius = np.array(self.radius)
        self.sums = np.concatenate(([0], np.cumsum(self.weight)))

    def __getstate__(self) -> dict:
        """Vectors travel as they came, often half as wide as unit vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "sketch")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.x = unit(self.vectors)
        self.sketch = sketch(self.x, self.basis)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every integer of the ranges."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def dual(a: Tree, b: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of each point of a and of b across the two trees, and links
    (point of a, point of b) that span what is linked."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    gain_a, gain_b = np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)
    forest, out = common.Forest(len(a.x) + len(b.x)), []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        for gain, at, s, own, other in ((gain_a, i, a, j, b), (gain_b, j, b, i, a)):
            w = other.sums[other.end[own]] - other.sums[other.start[own]]
            np.add.at(gain, s.start[at], w)
            np.add.at(gain, s.end[at], -w)
        row, p = spread(a.start[i], a.end[i])
        one = p, b.centre[j][row] + len(a.x)
        row, q = spread(b.start[j], b.end[j])
        two = a.centre[i][row], q + len(a.x)
        x, y = forest.add(np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1])))
        out.append((x, y - len(a.x)))

    def sort_out(i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settles what is decided; returns the node pairs to open."""
        both = a.radius[i] + b.radius[j]
        single = (a.end[i] - a.start[i] == 1) & (b.end[j] - b.start[j] == 1)
        rest = reach - SLACK - both
        inside = np.where(single, dot >= cosine, (rest >= 0) & (dot >= 1.0 - rest * rest / 2.0))
        if inside.any():
            settle(i[inside], j[inside])
        go = ~single & ~inside & (dot >= 1.0 - (both + reach + SLACK) ** 2 / 2.0)
        return i[go], j[go]

    def close(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the two sets of nodes that may hold a link. Nodes of like
        radius stand together, as the widest of a strip set its bound."""
        i, j = i[np.argsort(a.radius[i], kind="stable")], j[np.argsort(b.radius[j], kind="stable")]
        p, q = a.centre[i], b.centre[j]
        left, right, held, n = a.sketch[p], b.sketch[q], [], 0
        for lo in range(0, len(i), STRIP):
            hi = min(len(i), lo + STRIP)
            for at in range(0, len(j), WIDTH):
                end = min(len(j), at + WIDTH)
                far = a.radius[i[hi - 1]] + b.radius[j[end - 1]] + reach + SLACK
                k, m, dot = near(left[lo:hi], right[at:end], a.x, p[lo:hi], b.x, q[at:end], 1.0 - far * far / 2.0)
                if len(k):
                    held.append((i[lo + k], j[at + m], dot))
                    n += len(k)
                if n >= PAIRS:
                    yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
                    held, n = [], 0
        if n:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))

    zero = np.zeros(1, np.int64)
    fi, fj = sort_out(zero, zero, np.array([a.x[a.centre[0]] @ b.x[b.centre[0]]]))
    while len(fi):
        # a leaf stands for itself when only the other side opens
        alo, ahi = np.where(a.high[fi] > 0, a.low[fi], fi), np.where(a.high[fi] > 0, a.high[fi], fi + 1)
        blo, bhi = np.where(b.high[fj] > 0, b.low[fj], fj), np.where(b.high[fj] > 0, b.high[fj], fj + 1)
        size = (ahi - alo) * (bhi - blo)
        nexts = []
        # what one node meets is a product where it is much, whichever nodes it meets
        by = np.argsort(fi, kind="stable")
        edges = np.flatnonzero(np.diff(fi[by], prepend=-1))
        much = np.add.reduceat(size[by], edges) >= BLOCKED
        for lo, hi in zip(edges[much], np.append(edges[1:], len(by))[much], strict=True):
            k = by[lo:hi]
            for found in close(np.arange(alo[k[0]], ahi[k[0]]), spread(blo[k], bhi[k])[1]):
                nexts.append(sort_out(*found))
        few = by[~np.repeat(much, np.diff(np.append(edges, len(by))))]
        stop = np.cumsum(size[few])
        for lo in range(0, int(stop[-1]) if len(few) else 0, PAIRS):
            hi = min(int(stop[-1]), lo + PAIRS)
            flat, (top, end) = np.arange(lo, hi), np.searchsorted(stop, (lo, hi - 1), "right")
            held = np.minimum(stop[top : end + 1], hi) - np.maximum(stop[top : end + 1] - size[few[top : end + 1]], lo)
            row = np.repeat(np.arange(top, end + 1), held)
            k = few[row]
            at = flat - (stop[row] - size[k])
            wide = bhi[k] - blo[k]
            i, j = alo[k] + at // wide, blo[k] + at % wide
            nexts.append(sort_out(i, j, np.einsum("nd,nd->n", a.x[a.centre[i]], b.x[b.centre[j]])))
        fi, fj = (np.concatenate([n[s] for n in nexts] or [zero[:0]]) for s in (0, 1))
    la, lb = (np.concatenate([o[s] for o in out]) if out else np.zeros(0, np.int64) for s in (0, 1))
    return np.cumsum(gain_a)[:-1], np.cumsum(gain_b)[:-1], la, lb


def usable(vec):
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def placed_at(rows: DataFrame, pivots: np.ndarray, group: np.ndarray, dim: int) -> DataFrame:
    """``rows`` (cid, weight, vec, cell, far) with the nearest of those pivots
    whose group is the row's cell as new cell, and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, group = shared.value
        for b in common.batches_of(batches, 4096):
            x, cell, far = unit(matrix(b.column(2), dim)), b.column(3).to_numpy().copy(), np.zeros(b.num_rows)
            for c in np.unique(b.column(3).to_numpy()).tolist():
                at, mine = np.flatnonzero(b.column(3).to_numpy() == c), np.flatnonzero(group == c)
                dot = x[at] @ pivots[mine].T
                best = dot.argmax(axis=1)
                cell[at], far[at] = mine[best], chord(dot[np.arange(len(at)), best])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cell.astype(np.int32)), pa.array(far)], names=["cid", "weight", "vec", "cell", "far"])

    return materialize(rows.select("cid", "weight", "vec", "cell", "far").mapInArrow(run, rows.select("cid", "weight", "vec", "cell", "far").schema), "cells")


def class_links(classes: DataFrame, dim: int, cosine: float, cells: int, block: int | None) -> DataFrame:
    """(a, b, n) over classes (cid, weight, vec): n is the weight linked to
    class a across other classes where b is null, otherwise a and b are linked."""
    spark = classes.sparkSession
    total = classes.count()
    block = block or max(256, min(BLOCK_BYTES // (8 * dim), -(-total // LEAST_BLOCKS)))
    wanted = max(1, min(cells, -(-total // block)))
    # at most CELLS pivots or SAMPLE rows here and SUBCELLS for each cell below: stated bounds for the driver and the broadcast
    as_rows = lambda found: unit(np.array([r["vec"] for r in found], np.float64).reshape(-1, dim))
    first_rows = as_rows(classes.orderBy(F.xxhash64("cid"), "cid").limit(max(wanted, SAMPLE)).select("vec").collect())
    basis = directions(first_rows[:SAMPLE], cosine)
    pivots, group = first_rows[:wanted], np.zeros(wanted, np.int64)
    placed = placed_at(classes.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}), pivots, group, dim)
    sizes = lambda: {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    stat = sizes()
    large = {c: r["n"] for c, r in stat.items() if 2 * r["n"] > 3 * block}
    if large:
        share = F.lit([min(SUBCELLS, -(-large[c] // block)) / large[c] if c in large else 0.0 for c in range(len(pivots))])
        drawn = placed.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(1 << 30)) < share[F.col("cell")] * float(1 << 30)).select("cell", "vec").collect()
        split = {r["cell"] for r in drawn}
        kept = [c for c in range(len(pivots)) if c not in split]
        pivots, group = np.concatenate([pivots[kept], as_rows(drawn)]), np.array([*kept, *(r["cell"] for r in drawn)])
        placed = placed_at(placed, pivots, group, dim)
        stat = sizes()
    radius = np.array([stat[c]["far"] if c in stat else 0.0 for c in range(len(pivots))])
    parts = np.array([-(-2 * stat[c]["n"] // (3 * block)) if c in stat else 0 for c in range(len(pivots))])
    first = np.concatenate(([0], np.cumsum(parts)))  # number of a cell's first block
    pairs = int(first[-1]) * (int(first[-1]) + 1) // 2
    layout = spark.sparkContext.broadcast((pivots, radius, parts, first, basis))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts.tolist())[F.col("cell")]).cast("int"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, parts, first, basis = layout.value
        reach = np.sqrt(2 - 2 * cosine) + SLACK

        def emit(cell: int, part: int, rows: list) -> Iterator[pa.RecordBatch]:
            ids, weight, x = (np.concatenate(v) for v in zip(*rows, strict=True))
            tree = pickle.dumps(Tree(x, ids, weight, basis), protocol=5)
            me = int(first[cell]) + part
            gap = chord(np.clip(pivots @ pivots[cell], -1, 1))
            for c in np.flatnonzero((gap <= radius + radius[cell] + reach) & (parts > 0)):
                for other in range(int(first[c]), int(first[c] + parts[c])):
                    i, j = min(me, other), max(me, other)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([j], pa.int64()), pa.array([int(me != i)], pa.int32()), pa.array([tree], pa.binary())], names=["i", "j", "side", "tree"])

        key, rows = None, []
        for b in batches:
            cell, part = (b.column(k).to_numpy() for k in (0, 1))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)], strict=True):
                if hi == lo:
                    continue
                if key is not None and key != (cell[lo], part[lo]):
                    yield from emit(int(key[0]), int(key[1]), rows)
                    rows = []
                key = (cell[lo], part[lo])
                rows.append((b.column(2).slice(lo, hi - lo).to_numpy(), b.column(3).slice(lo, hi - lo).to_numpy(), matrix(b.column(4).slice(lo, hi - lo), dim)))
        if rows:
            yield from emit(int(key[0]), int(key[1]), rows)

    trees = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").select("cell", "part", "cid", "weight", "vec").mapInArrow(grow, "i long, j long, side int, tree binary")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Tree | None = None
        for b in batches:
            for i, j, side, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = pickle.loads(data)  # written by grow() above, in this job
                if i != j and side == 0:
                    held = tree
                    continue
                a = tree if i == j else held
                na, nb, la, lb = dual(a, tree, cosine)
                if i == j:
                    counted = [(a.ids, na - a.weight)]
                else:
                    counted = [(a.ids, na), (tree.ids, nb)]
                ids, n = (np.concatenate(v) for v in zip(*counted, strict=True))
                x, y = a.ids[la], tree.ids[lb]
                other = x != y
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids[n > 0], x[other]))),
                        pa.array(np.concatenate((np.zeros((n > 0).sum(), np.int64), y[other])), mask=np.arange((n > 0).sum() + other.sum()) < (n > 0).sum()),
                        pa.array(np.concatenate((n[n > 0], np.zeros(other.sum(), np.int64)))),
                    ],
                    names=["a", "b", "n"],
                )

    return trees.repartition(max(1, min(pairs, MOST_TASKS)), "i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(walk, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, block: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``block`` is the
    number of classes in a block (None: by BLOCK_BYTES)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    ok = usable(F.col("vec")) & F.col("vec_id").isNotNull()
    good = rows.where(ok).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec", F.size("vec")).alias("h2"))
    classes = materialize(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("vec").alias("vec")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for (dim,) in classes.select(F.size("vec")).distinct().collect():
        links = class_links(classes.where(F.size("vec") == dim), dim, cosine, cells, block)
        found = links if found is None else found.unionByName(links)
    alone = F.col("vec_id").alias("component_id")
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.col("vec_id").isNotNull().alias("kept"))
    if found is None:
        return rest
    found = materialize(found, "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    comp = common.components(found.where("b IS NOT NULL")).withColumnRenamed("node", "cid")
    slim = classes.select("cid", "h1", "h2", "first", "weight")
    # rows that repeat a vec_id with other vectors: its component is the smallest
    inner = slim.join(comp, "cid").select("cid", "component", "first")
    lowest = inner.groupBy("component").agg(F.min("first").alias("lowest"))
    named = common.salted_join(inner.select("cid", "component"), lowest, "component").select("cid", "lowest")
    by_class = slim.join(counts, "cid", "left").join(named, "cid", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("component_id"))
    linked = good.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rest)


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings. The cases are those of the module."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.r AS x, b.r AS y, b.vec_id AS other
  FROM ok a JOIN ok b ON a.r <> b.r WHERE len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(x, y) AS (
  SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), comp AS (SELECT reach.x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.x = v.r LEFT JOIN deg ON deg.x = v.r
"""
