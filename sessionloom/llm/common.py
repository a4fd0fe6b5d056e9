"""Shared pieces: bounded Arrow batches, training samples, byte-level text
vectors and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.runtime import materialize

ROWS_PER_BATCH = 256
SAMPLE_PARTS = 12
SLICE_BYTES = 1 << 18


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Spark bounds its Arrow batches in bytes; here they are cut to few rows,
    so that what is made of them stays small too."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def per_text(docs: DataFrame, keep: list[str], schema: str, work: Callable[[list], dict], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus what ``work(list of texts)`` returns as columns. Where
    text_col is a.b, the text is field b of the kept struct a and travels once."""
    whole, _, field = text_col.rpartition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            texts = b.column(keep.index(whole)).field(field) if whole else b.column(len(keep))
            made = work(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]], names=[*keep, *made])

    fields = T.StructType([*(docs.schema[k] for k in keep), *T.StructType.fromDDL(schema)])
    return docs.select(*keep, *([] if whole else [text_col])).mapInArrow(run, fields)


def numbered(docs: DataFrame, name: str, **more) -> DataFrame:
    """The rows as a written table (rid, row and the columns ``more``): a row
    keeps its number, whatever its ids and column names are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return materialize(whole.select(F.monotonically_increasing_id().alias("rid"), "row", *[c.alias(n) for n, c in more.items()]), name)


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo n; null ids count as remainder
    null, so they are neither learned from nor held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, max_chars: int) -> DataFrame:
    """(k, y, text) of at most ``per_class`` labelled documents of each of the
    labels 0 and 1, the first by a hash k of the id, written to the shared folder.

    Rows with null ids, labels or texts, other label values and texts over
    ``max_chars`` are left out before the choice, as are labels without such a
    document. Ids that carry both labels are not learned from; of rows that
    repeat an id the smallest text counts."""
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2"))
        .where("y = y2")
        .join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", "y", F.xxhash64("doc_id").alias("k"))
    )
    parts = [rows.where(F.col("y") == y).orderBy("k", "doc_id").limit(per_class) for y in (0, 1)]
    ids = materialize(parts[0].unionByName(parts[1]), "sample-ids")
    # at most 2 * per_class ids: a stated bound, so the broadcast is safe
    texts = usable.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "k", "y").agg(F.min("text").alias("text"))
    return materialize(texts.select("k", "y", "text").repartition(SAMPLE_PARTS, "k"), "sample")


def spread_out(sample: DataFrame) -> DataFrame:
    """A written sample dealt to SAMPLE_PARTS tasks, however few its bytes."""
    return sample.repartition(SAMPLE_PARTS, "k")


def texts_of(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[bytes]]:
    for b in batches_of(batches):
        yield [(t or "").encode("utf-8", "surrogatepass") for t in b.column(column).to_pylist()]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, b in (("p", _BASE), ("q", _INVERSE)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t)
    return _tables["p"], _tables["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with hash(buf[s:e]) = (P[e] - P[s]) * inverse^s."""
    p, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of a mask."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slices(datas: list[bytes], cut: bytes = b" \n\t") -> Iterator[tuple[list[int], list[bytes]]]:
    """Group texts into slices of about SLICE_BYTES; a longer text comes alone
    and in pieces that end at one of the ASCII separators ``cut``."""
    who, part, total = [], [], 0
    for i, d in enumerate(datas):
        if len(d) > SLICE_BYTES:
            for piece in pieces(d, cut):
                yield [i], [piece]
            continue
        if total + len(d) > SLICE_BYTES and part:
            yield who, part
            who, part, total = [], [], 0
        who.append(i)
        part.append(d)
        total += len(d)
    if part:
        yield who, part


def pieces(data: bytes, cut: bytes = b" \n\t") -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and data[end] not in cut:
            end += 1
        yield data[at:end]
        at = end


def joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice in one buffer, each followed by a newline, and the
    end offset of each."""
    buf = np.frombuffer(b"\n".join([*part, b""]), np.uint8)
    return buf, np.cumsum([len(p) + 1 for p in part])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, component), component being the smallest
    node reachable; nodes without an edge to another node do not occur.

    Alternates large-star and small-star contraction, each round written to the
    shared folder; edges stay linear in the number of nodes and nothing is
    collected but a count and a checksum for each round."""
    spark = edges.sparkSession
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of each join are plain exchanges: AQE splits the root of a large component, which has most edges
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots) if mark else spark.createDataFrame([], stars.schema)


def salted_join(rows: DataFrame, values: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Inner join with ``values``, which has one row for each key: the rows of
    a key are dealt to ``salts`` tasks by their other columns, and each value
    goes to all of them."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(salts)).cast("int"))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


class Forest:
    """Union-find over 0..n-1 that says which links join two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = p
                return p
            p = q

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes links, returns those of them that a spanning forest needs."""
        r = self.roots()
        open_ = r[i] != r[j]
        i, j, used = i[open_], j[open_], []
        if len(i) > 1:  # of links between the same two trees the first is enough
            ends = np.minimum(r[i], r[j]) * len(r) + np.maximum(r[i], r[j])
            first = np.sort(np.unique(ends, return_index=True)[1])
            i, j = i[first], j[first]
        p = self.parent
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            while p[x] != x:
                x = p[x]
            while p[y] != y:
                y = p[y]
            if x != y:
                p[max(x, y)] = min(x, y)
                used.append(k)
        return i[used], j[used]
