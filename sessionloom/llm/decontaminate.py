"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: each segment (about 1 MB of text, one
row of a Parquet table in the shared folder) holds, for each term of the test
vocabulary, the sorted list of (document, position). A phrase is answered in
each segment by intersecting the lists of its terms, moved by their offsets,
rarest term of the corpus first. Lists never leave their segment, so no term,
however frequent, is gathered anywhere. The index is built once, for all terms of
the test items (for all terms of the corpus where the items have more than
VOCABULARY), and asked by blocks of items.

Defined cases: null or word-less texts have no words and are never hit; an item
without words has no window; a null item_id hits words but is not listed among
items; repeated items and documents count as one item and as rows of their own.
Only doc_id/text and item_id/text are read, further columns do not matter; ids
are integers. Terms are compared by the XXH64 of their bytes: two different
words of a corpus of n distinct ones share a hash with a chance of about n^2 / 2^65,
and to matter they must also stand in the same place of a test window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

WINDOW = 13
BLOCK_WORDS = 1 << 18  # words of test items that one pass over the index asks for
VOCABULARY = 1 << 22  # distinct terms of test items, 32 MB of hashes
_WORD = np.ones(256, bool)
_WORD[:0x80] = False
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATORS = bytes(c for c in range(0x80) if not _WORD[_LOWER[c]])
SHIFT = 40  # a posting is (document in segment) << SHIFT | position


_SPACED = bytes(_LOWER[c] if _WORD[_LOWER[c]] else 0x20 for c in range(256))


def terms(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, A-Z lower-cased."""
    words = data.translate(_SPACED).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_terms(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    got = [terms(p) for p in common.pieces(data, _SEPARATORS)]
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


@dataclass
class Windows:
    """Distinct windows, one in a row of ``terms`` (short ones padded with 0),
    with their lengths and, from first[k] to first[k + 1], the ids of the items
    they are in; ordered by the term that is rarest in the corpus."""

    terms: np.ndarray
    length: np.ndarray
    first: np.ndarray
    items: np.ndarray
    rarest: np.ndarray
    rank: np.ndarray  # how often the corpus holds each term of a window


def item_windows(items: list[tuple[int | None, str | None]], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms, length, first and items of Windows, in any order of windows."""
    rows, length, owner, known = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for item_id, text in items:
        h = text_terms(text)
        if len(h):
            n = max(1, len(h) - size + 1)
            rows.append(np.lib.stride_tricks.sliding_window_view(h, size) if len(h) >= size else np.pad(h, (0, size - len(h)))[None])
            length.append(np.full(n, min(size, len(h))))
            owner.append(np.full(n, item_id or 0))
            known.append(np.full(n, item_id is not None))
    every = np.concatenate([np.concatenate(rows), np.concatenate(length)[:, None].astype(np.uint64)], 1)
    distinct, which = np.unique(every, axis=0, return_inverse=True)
    # an item once in each of its windows; items without an id in none
    pair = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)], 1)[np.concatenate(known)], axis=0)
    first = np.searchsorted(pair[:, 0], np.arange(len(distinct) + 1))
    return distinct[:, :size], distinct[:, size].astype(np.int64), first, pair[:, 1]


def ranked(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], terms_: np.ndarray, counts: np.ndarray) -> Windows:
    """The windows whose terms all occur; ``terms_`` is sorted."""
    rows, length, first, items = found
    at = np.minimum(np.searchsorted(terms_, rows), max(0, len(terms_) - 1))
    rank = np.where(terms_[at] == rows, counts[at], 0) if len(terms_) else np.zeros(rows.shape, np.int64)
    inside = np.arange(rows.shape[1]) < length[:, None]
    rank = np.where(inside, rank, np.iinfo(np.int64).max)
    keep = np.flatnonzero((rank > 0).all(1))
    rarest = rows[keep, rank[keep].argmin(1)] if len(keep) else np.zeros(0, np.uint64)
    keep, rarest = keep[np.argsort(rarest, kind="stable")], np.sort(rarest, kind="stable")
    n = first[keep + 1] - first[keep]
    start = np.concatenate(([0], np.cumsum(n)))
    flat = np.repeat(first[keep] - start[:-1], n) + np.arange(n.sum())
    return Windows(rows[keep], length[keep], start, items[flat], rarest, rank[keep])


SEGMENT = "segment long, doc_ids array<long>, n_words array<long>, terms array<long>, ends array<long>, postings binary"


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The index as a DataFrame, one row for each segment. ``vocabulary``:
    sorted term hashes to keep (None: all terms of the texts)."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segment(ids: list, hashes: list[np.ndarray], first: int) -> list:
        n = [len(h) for h in hashes]
        h = np.concatenate(hashes)
        at = np.repeat(np.arange(len(n), dtype=np.int64) << SHIFT, n) + np.concatenate([np.arange(k) for k in n])
        if vocab.value is not None and len(h):
            v = vocab.value
            keep = v[np.minimum(np.searchsorted(v, h), len(v) - 1)] == h if len(v) else np.zeros(len(h), bool)
            h, at = h[keep], at[keep]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        ends = np.flatnonzero(np.concatenate((h[1:] != h[:-1], [True]))) + 1 if len(h) else np.zeros(0, np.int64)
        return [first, ids, n, h[ends - 1].view(np.int64), ends, at.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches_of(batches):
            ids, texts = b.column(0).to_pylist(), [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            part: list[tuple[int, list[np.ndarray]]] = []
            size, rows = 0, []
            flush = lambda: segment([ids[k] for k, _ in part], [np.concatenate(x) for _, x in part], 0)
            for who, datas in common.slices(texts, _SEPARATORS):
                for i, x in zip(who, map(terms, datas), strict=True):
                    if part and part[-1][0] == i:
                        part[-1][1].append(x)  # a further piece of a long text
                        size += len(x)
                        continue
                    if size > 1 << 18:
                        rows.append(flush())
                        part, size = [], 0
                    part.append((i, [x]))
                    size += len(x)
            if part:
                rows.append(flush())
            for r in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0]], pa.int64()), pa.array([r[1]], pa.list_(pa.int64())), pa.array([r[2]], pa.list_(pa.int64())), pa.array([r[3]], pa.list_(pa.int64())), pa.array([r[4]], pa.list_(pa.int64())), pa.array([r[5]], pa.binary())],
                    names=["segment", "doc_ids", "n_words", "terms", "ends", "postings"],
                )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENT)
    return made.withColumn("segment", F.monotonically_increasing_id())


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each indexed term occurs in the whole corpus."""
    return (
        index.select(F.arrays_zip("terms", "ends", F.expr("slice(array_insert(ends, 1, 0L), 1, size(ends))").alias("starts")).alias("z"))
        .select(F.explode("z").alias("z"))
        .groupBy(F.col("z.terms").alias("term"))
        .agg(F.sum(F.col("z.ends") - F.col("z.starts")).alias("n"))
    )


class Lists:
    """The postings of one segment."""

    def __init__(self, terms_: np.ndarray, ends: np.ndarray, postings: bytes):
        self.terms, self.ends, self.at = terms_.view(np.uint64), ends, np.frombuffer(postings, np.int64)

    def __getitem__(self, term: int) -> np.ndarray:
        k = int(np.searchsorted(self.terms, np.uint64(term)))
        if k == len(self.terms) or int(self.terms[k]) != term:
            return self.at[:0]
        return self.at[(self.ends[k - 1] if k else 0) : self.ends[k]]

    def phrase(self, window: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Postings at which the window starts: rarest term first."""
        found = None
        for o in np.argsort(rank, kind="stable").tolist():
            at = self[int(window[o])] - o
            if found is None:
                found = at
            elif len(found):
                if not len(at):
                    return at
                k = np.minimum(np.searchsorted(at, found), len(at) - 1)
                found = found[at[k] == found]
            if not len(found):
                return found
        # an offset can carry a start below zero into the document before
        return found[(found & ((1 << SHIFT) - 1)) < (1 << (SHIFT - 1))]

    def near(self, first: int, second: int, slop: int) -> np.ndarray:
        """Postings of ``first`` with ``second`` at most ``slop`` words away in
        the same document, in either order; a position is not near itself."""
        a, b = self[first], self[second]
        if not len(a) or not len(b):
            return a[:0]
        b = np.unique(b)
        lo, hi = np.searchsorted(b, a - slop), np.searchsorted(b, a + slop, "right")
        own = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
        doc = a >> SHIFT
        same = np.array([bool(((b[x:y] >> SHIFT) == d).sum() - o > 0) for x, y, d, o in zip(lo, hi, doc, own, strict=True)], bool)
        return a[same]


def proximity(index: DataFrame, first: str, second: str, slop: int) -> DataFrame:
    """(doc_id, position) of ``first`` within ``slop`` words of ``second``."""
    one, two = (int(text_terms(w)[0]) for w in (first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, t, e, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = Lists(np.array(t, np.int64), np.array(e, np.int64), p).near(one, two, slop)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in (at >> SHIFT).tolist()], pa.int64()), pa.array(at & ((1 << SHIFT) - 1))], names=["doc_id", "position"])

    return index.select("doc_ids", "terms", "ends", "postings").mapInArrow(run, "doc_id long, position long")


def spans(index: DataFrame, windows: Windows) -> DataFrame:
    """For every document (segment, ord, doc_id, n_words): the merged spans of
    its words that windows cover, and the items of those windows."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # of BLOCK_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            for seg, ids, n, t, e, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5).to_pylist(), strict=True):
                lists = Lists(np.asarray(t.values, np.int64), np.asarray(e.values, np.int64), p)
                hit: dict[int, list[tuple[int, int]]] = {}
                which: dict[int, set] = {}
                for k in np.flatnonzero(np.isin(w.rarest, lists.terms)).tolist():
                    size = int(w.length[k])
                    for at in lists.phrase(w.terms[k, :size], w.rank[k, :size]).tolist():
                        d, s = at >> SHIFT, at & ((1 << SHIFT) - 1)
                        hit.setdefault(d, []).append((s, s + size))
                        which.setdefault(d, set()).update(w.items[w.first[k] : w.first[k + 1]].tolist())
                merged = []
                for d in range(len(ids)):
                    own: list[list[int]] = []
                    for s, z in sorted(hit.get(d, ())):
                        if own and s <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], z)
                        else:
                            own.append([s, z])
                    merged.append([{"s": s, "e": z} for s, z in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seg] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(merged, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(which.get(d, ())) for d in range(len(ids))], pa.list_(pa.int64()))],
                    names=["segment", "ord", "doc_id", "n_words", "spans", "items"],
                )

    return index.select("segment", "doc_ids", "n_words", "terms", "ends", "postings").mapInArrow(run, "segment long, ord int, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<long>")


def distinct_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches_of(batches):
            found = np.unique(np.concatenate([text_terms(t) for t in b.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["term"])

    return items.select("text").mapInArrow(run, "term long").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged, end exclusive, in
    words), items (ids whose windows occur). Equal rows of the benchmark are read once.

    The test items are the stated query set: they are read in blocks of about
    ``block_words`` words (a longer single item makes its own block), and every
    block is asked of the one index of all documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    wanted = materialize(distinct_terms(items), "terms")
    vocabulary = np.sort(wanted.toArrow()["term"].to_numpy().view(np.uint64)) if wanted.count() <= VOCABULARY else None
    # segments and the order of documents in them are written down here
    index = materialize(build_index(docs, vocabulary), "index")
    counts = materialize(term_counts(index), "term-counts")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (6 * block_words)))
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().to_pydict()
        found = item_windows(list(zip(block["item_id"], block["text"], strict=True)), size)
        own = np.unique(found[0])  # at most the block's words
        got = counts.join(F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(own.view(np.int64))}))), "term").toArrow()
        order = np.argsort(got["term"].to_numpy().view(np.uint64))
        parts.append(spans(index, ranked(found, got["term"].to_numpy().view(np.uint64)[order], got["n"].to_numpy()[order])))
    if blocks == 1:
        return parts[0].drop("segment", "ord")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("segment", "ord", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.withColumn("spans", _merge(F.array_sort("spans"))).drop("segment", "ord")


def _merge(ordered):
    """Overlapping or touching spans of a sorted array made one."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        ordered,
        F.slice(ordered, 1, 1),
        lambda acc, x: F.when(
            x["s"] <= last(acc)["e"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns of what contamination() returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    rows = common.numbered(docs, "rows")
    found = report(contamination(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), benchmark, size))
    return common.unwrapped(rows.join(found.where("contaminated").select(F.col("doc_id").alias("rid")), "rid", "left_anti"), docs.columns)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hit. The cases are those of
    the module."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(contamination(docs, items))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_aggregate(list_slice(w, i, i + least(13, len(w)) - 1), 'string_agg', ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT d.r, d.i, win.k, win.item_id
  FROM (SELECT r, k, i, list_aggregate(list_slice(w, i, i + k - 1), 'string_agg', ' ') AS p
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, ks WHERE len(w) >= k)) d
  JOIN win ON win.p = d.p AND win.k = d.k
), hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
