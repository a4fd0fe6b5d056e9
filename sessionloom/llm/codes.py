"""Vector code compression: product codes found by partial-distance search.

Components become integers and vectors are cut into equal parts. Each part
position has a codebook, fitted by rounds of assignment and floored means; a
vector's code names the nearest entry of each of its parts.

The nearest entry is found by partial distances: the dimensions of a part are
taken in descending variance of its codebook, so that most of a distance comes
early, and an entry is dropped for a vector as soon as its accumulated distance
is over that of the best entry so far. Entries are taken in order and only a
smaller distance replaces the best, so ties go to the lower index. Distances are
integers: dropping loses nothing.

Each round is one pass over the vectors. A task adds up its own vectors by entry;
what is shuffled and what the driver gets is one row for each entry and
dimension, whatever the number of vectors. Vectors themselves are read again in
each pass and never written or moved.

Defined cases: vectors that are null or hold null or non-finite components are
dropped. The length of the smallest kept vec_id's vector is the length of all:
others (and vectors of rows with a null id) never enter the first codebooks;
vectors of another length have null code and error and are not learned from. A
length that the parts do not divide is filled up with zeros at the end. Of rows
that repeat an id the smallest vector counts for the first codebooks; all of them
are learned from and coded. With fewer than ``entries`` ids codebooks are shorter.
Integers whose distances would not fit into 64 bits raise an error. Columns other
than vec_id, embedding and label are not read. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

ROWS = 4096  # vectors a task looks at together
SCALE = 4096


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, length, values): the rows that are kept, the length of each, and
    their integer components one after the other, as doubles that hold integers."""
    flat = column.flatten()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    values = np.floor(np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)) * scale)  # nulls come as NaN
    bad = np.zeros(len(lengths), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    np.add.at(bad, row[~np.isfinite(values)], 1)
    kept = (bad == 0) & np.asarray(column.is_valid())
    return np.flatnonzero(kept), lengths[kept], values[kept[row]]


def matrix(column: pa.Array, scale: int, length: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, whether each has the length, the vectors of those as integers
    filled up to a multiple of ``parts``)."""
    rows, lengths, values = integers(column, scale)
    right = lengths == length
    x = values[np.repeat(right, lengths)].reshape(-1, length) if length else np.zeros((int(right.sum()), 0))
    if x.size and np.abs(x).max() ** 2 * 4 * length >= 2.0**62:
        raise OverflowError("components are too large: distances would not fit into 64 bits")
    filled = np.zeros((len(x), -(-length // parts) * parts), np.int64)
    filled[:, :length] = x
    return rows, right, filled


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of ``book`` (entries, dimensions)
    that is nearest to each row of ``x``."""
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    columns, book = np.ascontiguousarray(x.T[order]), book[:, order]
    best, index = ((columns - book[0][:, None]) ** 2).sum(0), np.zeros(len(x), np.int64)
    for k in range(1, len(book)):
        left, sums = np.arange(len(x)), np.zeros(len(x), np.int64)
        for d in range(len(order)):
            off = columns[d, left] - book[k, d]
            sums += off * off
            open_ = sums <= best[left]
            if not open_.all():
                left, sums = left[open_], sums[open_]
        closer = sums < best[left]
        best[left[closer]], index[left[closer]] = sums[closer], k
    return index, best


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows, parts), and the squared distances summed over parts."""
    width = books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in found], 1), np.sum([d for _, d in found], 0)


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, np.ndarray]:
    """The vectors' length, and codebooks (parts, entries, width) of the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for b in common.batches_of(batches, ROWS):
            b = b.filter(b.column(0).is_valid())
            rows, lengths, values = integers(b.column(1), scale)
            ids = np.asarray(b.column(0))[rows]
            ends = np.cumsum(lengths)
            bar = np.unique(ids)[:entries].max(initial=-(1 << 63))
            for i in np.flatnonzero(ids <= bar).tolist():
                v = tuple(values[ends[i] - lengths[i] : ends[i]].tolist())
                least[int(ids[i])] = min(least.get(int(ids[i]), v), v)
            least = dict(sorted(least.items())[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array([list(v) for v in least.values()], pa.list_(pa.float64()))], names=["vec_id", "v"])

    # a task returns ``entries`` rows at most, and so does the limit
    found = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v array<double>")
    rows = found.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not rows:
        return 0, np.zeros((parts, 0, 0), np.int64)
    length = len(rows[0].v)
    width = -(-length // parts)
    whole = np.zeros((sum(len(r.v) == length for r in rows), width * parts), np.int64)
    whole[:, :length] = [r.v for r in rows if len(r.v) == length]
    return length, np.ascontiguousarray(whole.reshape(len(whole), parts, width).transpose(1, 0, 2))


def fitted(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """The vectors' length, and their codebooks after ``rounds`` passes."""
    length, books = first_books(vectors, parts, entries, scale)
    n, width = books.shape[1:]
    if not n or not width:
        return length, books
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)  # entries * length integers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in common.batches_of(batches, ROWS):
                _, _, x = matrix(b.column(0), scale, length, parts)
                index, _ = assigned(x, books) if len(x) else (np.zeros((0, parts), np.int64), None)
                for p in range(parts):
                    count[p] += np.bincount(index[:, p], minlength=n)
                    np.add.at(sums[p], index[:, p], x[:, p * width : (p + 1) * width])
            cell = np.flatnonzero(np.repeat(count.ravel() > 0, width))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell]), pa.array(np.repeat(count.ravel(), width)[cell])], names=["cell", "total", "n"])

        added = vectors.select("embedding").mapInArrow(run, "cell long, total long, n long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        flat = books.ravel().copy()
        flat[np.asarray(added["cell"])] = np.floor_divide(np.asarray(added["total"]), np.asarray(added["n"]))
        books = flat.reshape(books.shape)
        shared.unpersist()
    return length, books


def compressed(vectors: DataFrame, length: int, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code and error of every kept vector."""
    parts = len(books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for b in common.batches_of(batches, ROWS):
            rows, right, x = matrix(b.column(2), scale, length, parts)
            code, error = np.full(len(rows), None, object), np.zeros(len(rows), np.int64)
            if len(x):
                index, error[right] = assigned(x, books)
                code[right] = ["".join(r) for r in digits[index].tolist()]
            kept = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(code, pa.string()), pa.array(error, mask=~right)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def restored(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (the sum over equal labels, nulls being
    one label) and codebooks_sha256 of every kept vector."""
    length, books = fitted(vectors, parts, entries, rounds, scale)
    # written: the sums of labels come from it, and then the rows are read again
    made = materialize(compressed(vectors, length, books, scale).withColumn("_label", F.struct("label")), "codes")
    sums = made.groupBy("_label").agg(F.sum("error").alias("label_error"))
    joined = common.salted_join(made.drop("label"), sums, "_label")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by 8 codebooks of 16 entries, with the errors. The
    cases are those of the module."""
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> str:
    """The same, unrolled, for DuckDB; the length has to be a multiple of ``parts``."""
    steps = [
        "e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "s AS (SELECT vec_id, label, len(embedding) AS size, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM e)",
        f"v AS MATERIALIZED (SELECT vec_id, CAST(i // (size // {parts}) AS INT) AS part, CAST(i % (size // {parts}) AS INT) AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM s)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM e ORDER BY vec_id LIMIT {entries}))",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM v JOIN first USING (vec_id))",
    ]
    near = "SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (SELECT v.vec_id, v.part, c.entry, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{0} c ON v.part = c.part AND v.pos = c.pos GROUP BY ALL) GROUP BY vec_id, part"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        mean = "(SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM v JOIN a{0} USING (vec_id, part) GROUP BY part, entry, pos)".format(r)
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c.x ELSE (t - ((t % n) + n) % n) // n END AS x FROM c{r} c LEFT JOIN {mean} m USING (part, entry, pos))")
    steps.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    steps.append("q AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY vec_id)")
    steps.append("l AS (SELECT e.label, CAST(sum(error) AS BIGINT) AS label_error FROM q JOIN e USING (vec_id) GROUP BY e.label)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT q.vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM q JOIN e USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM e.label"""
    )
