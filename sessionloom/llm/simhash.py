"""Near-duplicate detection by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most four bits have a segment that differs in at most one bit, so they
share one of that segment's one-wildcard variants. Variants are joined on
equality and every pair that meets is verified.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero; all such rows are linked. Repeated rows and texts give one
result row each. A null doc_id keeps its row; it never becomes a component_id
unless no member has an id. Only doc_id and text are read, so further columns
of any name do not matter. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

BITS = 64
BLOCK = 4096
KEYS_PER_TASK = 1 << 19
SAMPLED = 16  # one fingerprint of so many counts towards the size of a bucket


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(shingle, len(words))
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ones, n, step = np.zeros(BITS, np.int64), len(words) - k + 1, 1 << 14
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        h = np.array([digest(whole[s:e], 42) for s, e in zip(start[lo:hi].tolist(), end[lo + k - 1 : hi + k - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""
    return common.per_text(docs, ["doc_id"], "fp long", lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)})


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one must differ in at
    most one bit: floor(distance / n) <= 1."""
    n = distance // 2 + 1
    cut = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def variants(fp, distance: int):
    """All one-wildcard variants of all segments, each packed into a long:
    the wildcard's bit number, then the segment with that bit cleared."""
    made = []
    for off, width in segments(distance):
        seg = F.shiftrightunsigned(fp, off).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else fp
        for j in range(width):
            cleared = seg.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))
            made.append(cleared.bitwiseOR(F.lit((off + j) << 32)) if width <= 32 else F.xxhash64(cleared, F.lit(off + j)))
    return F.array(*made)


def linked(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at
    most ``distance`` bits: not all of them, but a spanning forest of those that
    meet in each bucket, so reachability is that of all links.

    A bucket of more than about BLOCK rows is dealt to pairs of blocks, so that
    no task holds a whole bucket. How many rows it has is estimated from one
    fingerprint in SAMPLED: that decides how it is dealt, not what is compared."""
    number = BITS * fps.count()  # variants: one for each bit
    dealt = fps.select("fp").repartition(max(8, -(-number // KEYS_PER_TASK)), "fp")
    keys = dealt.select("fp", F.explode(variants(F.col("fp"), distance)).alias("key"))
    some = dealt.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SAMPLED)) == 0).select(F.explode(variants(F.col("fp"), distance)).alias("key"))
    # written: Spark then knows how few they are before it plans the join, and keys travel once
    large = materialize(some.groupBy("key").agg((F.count("*") * SAMPLED).alias("count")).where(F.col("count") > BLOCK), "large")
    near = (
        keys.join(large, "key", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK).cast("int"), F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "fp", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q", "fp")
        .select("key", "p", "q", "fp")
    )

    def pairs(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(fp, return_inverse=True)
        forest, out = common.Forest(len(node)), []
        i = np.arange(len(fp))
        for lag in range(1, len(fp)):
            i = i[i + lag < len(fp)]
            i = i[group[i] == group[i + lag]]
            if not len(i):
                break
            close = np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance
            x, y = forest.add(at[i[close]], at[i[close] + lag])
            out.append((node[x], node[y]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
        return a.view(np.int64), b.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            change = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
            group = np.concatenate(([0], np.cumsum(change)))
            done = (group < group[-1]) | last
            if not done.all():  # the last group may go on in the next batch
                held.append([c[~done] for c in cols])
            a, z = pairs(group[done], cols[3][done].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if sum(len(h[0]) for h in held) >= 1 << 15:
                yield flush(False)
        if held:
            yield flush(True)

    return near.mapInArrow(run, "a long, b long")


def roots(classes: DataFrame, first: str, distance: int) -> DataFrame:
    """(fp, and in ``first`` the smallest ``first`` of its group) of the rows of
    ``classes`` (fp, first), which has each fingerprint once."""
    classes = materialize(classes, "classes")
    comp = common.components(linked(classes, distance))
    inner = classes.join(comp.withColumnRenamed("node", "fp"), "fp").select("fp", "component", first)
    lowest = inner.groupBy("component").agg(F.min(first).alias("lowest"))
    named = common.salted_join(inner.select("fp", "component"), lowest, "component").select("fp", "lowest")
    return classes.join(named, "fp", "left").select("fp", F.coalesce("lowest", first).alias(first))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The documents, one of each near-duplicate group: that with the smallest
    doc_id, null ids last, and of rows that repeat an id one."""
    rows = common.numbered(docs, "rows")
    keyed = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    fps = materialize(common.per_text(keyed, ["rid", "doc_id"], "fp long", lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    # copies collapse to one row of each fingerprint before anything is compared
    kept = roots(fps.groupBy("fp").agg(first), "first", distance).select("first.rid").distinct()
    return common.unwrapped(rows.join(kept, "rid", "left_semi"), docs.columns)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints collapse before any comparison, so large groups of copies
    cost no more than one; components are over distinct fingerprints."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    # written, so that both sides of the join are plain exchanges, which AQE splits where one fingerprint is frequent
    classes = materialize(roots(fps.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "component_id", distance), "components")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. The cases are those of the
    module."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
