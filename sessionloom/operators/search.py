"""Full-text search as joins over an inverted index, made on the way (``build``)
or written in parts by term and added to (``write``), of which a question reads the
parts of its words only (``read``).

Queries are built from functions (``term``, ``phrase``, ``prefix``, ``near`` and the
set operations), not from a query language, and words match as they are written,
without stemming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BUCKETS, BUCKET, ADDED = 64, "_bucket", "_added"
ROWS = 65_536  # postings handed on at once
_WORD = r"[\p{L}\p{N}]+"
# Letters with marks and what they are searched as.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without marks on letters."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN), F.lit(f"({_WORD})"), F.lit(1))


def build(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The index: (id, field, term, pos), one row for each word."""
    parts = [rows.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.posexplode(words(F.col(f))).alias("pos", "term")) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def _in(index: DataFrame, field: str | None) -> DataFrame:
    return index if field is None else index.where(F.col("field") == field)


def _plain(word: str) -> str:
    return word.lower().translate(str.maketrans(_MARKED, _PLAIN))


def term(index: DataFrame, word: str, field: str | None = None) -> DataFrame:
    """Ids of rows with the word."""
    return _in(index, field).where(F.col("term") == _plain(word)).select("id").distinct()


def prefix(index: DataFrame, start: str, field: str | None = None) -> DataFrame:
    return _in(index, field).where(F.col("term").startswith(_plain(start))).select("id").distinct()


def phrase(index: DataFrame, text: list[str], field: str | None = None) -> DataFrame:
    """Ids of rows with the words next to each other: each word votes for where
    the phrase would start, and a start with all votes is one."""
    votes = None
    for k, word in enumerate(text):
        at = _in(index, field).where(F.col("term") == _plain(word)).select("id", "field", (F.col("pos") - k).alias("start"), F.lit(k).alias("k"))
        votes = at if votes is None else votes.unionByName(at)
    return votes.groupBy("id", "field", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(text)).select("id").distinct()


def near(index: DataFrame, a: str, b: str, slop: int = 10, field: str | None = None) -> DataFrame:
    """Ids of rows with both words at most ``slop`` words apart. Positions fall
    into stretches of slop + 1 words; two near ones share one or are in
    neighbours, so this is an equality join."""
    at = lambda w, name: _in(index, field).where(F.col("term") == _plain(w)).select("id", "field", F.col("pos").alias(name), F.floor(F.col("pos") / (slop + 1)).alias("cell"))
    left = at(a, "p").withColumn("cell", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)))
    return left.join(at(b, "q"), ["id", "field", "cell"]).where((F.abs(F.col("p") - F.col("q")) <= slop) & (F.col("p") != F.col("q"))).select("id").distinct()


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.join(y, "id", "left_semi"), found)


def any_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def but_not(found: DataFrame, other: DataFrame) -> DataFrame:
    return found.join(other, "id", "left_anti")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    """The part of an index that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, term, at, len): the positions of a term in a field of a row, and
    how many words the row has, so that ranking needs no other table. Ids are unique.
    A row's words are grouped where they are, so nothing is shuffled."""
    cut = rows.select(F.col(id_col).alias("id"), *[words(F.col(f)).alias(f) for f in fields])
    sized = cut.withColumn("len", sum((F.size(f) for f in fields), F.lit(0)).cast("long"))
    parts = [sized.select("id", F.lit(f).alias("field"), F.col(f).alias("words"), "len") for f in fields]
    kind = sized.schema["id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, parts).mapInArrow(_grouped, f"id {kind}, field string, term string, at array<int>, len long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (id, field, words, len), those of equal terms beside each other."""
    for b in batches:
        held = b.column(2)
        code = held.flatten().dictionary_encode()
        n = held.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        term = code.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        term, row, pos = term[order], row[order], pos[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        first = np.append(np.flatnonzero(new), len(term))
        for lo in range(0, len(first) - 1, ROWS):
            at = first[lo : lo + ROWS + 1]
            here, positions = pa.array(row[at[:-1]]), pa.array(pos[at[0] : at[-1]], pa.int32())
            offsets = pa.array(at - at[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(here), b.column(1).take(here), code.dictionary.take(pa.array(term[at[:-1]])), pa.ListArray.from_arrays(offsets, positions), b.column(3).take(here)], names=["id", "field", "term", "at", "len"])


def totals(postings: DataFrame) -> DataFrame:
    """One row: docs with words, and their words. A row with words has one at the
    first place of some field."""
    return postings.agg(F.count_distinct(F.when(F.get("at", F.lit(0)) == 0, F.col("id"))).alias("docs"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("words"))


def write(rows: DataFrame, id_col: str, fields: list[str], folder: str, append: bool = True, buckets: int = BUCKETS) -> None:
    """Adds rows with new ids to an index in a folder, or replaces it. Postings are
    kept by addition and by a hash of the term, frequent terms in several files, and
    how many rows and words there are for each addition."""
    spark, added = rows.sparkSession, f"{folder}/postings/{ADDED}=a{uuid.uuid4().hex}"
    dealt = postings(rows, id_col, fields).withColumn(BUCKET, bucket(F.col("term"), buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "term")
    dealt.write.partitionBy(BUCKET).parquet(added)
    if not append:
        drop_others(spark, added)
    made = spark.read.schema(dealt.schema).parquet(added)
    totals(made).withColumn("buckets", F.lit(buckets)).write.mode("append" if append else "overwrite").parquet(f"{folder}/totals")


def drop_others(spark: SparkSession, added: str) -> None:
    """Deletes what lies beside an addition."""
    path = spark._jvm.org.apache.hadoop.fs.Path(added)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for other in fs.listStatus(path.getParent()):
        if other.getPath().getName() != path.getName():
            fs.delete(other.getPath(), True)


def read(spark: SparkSession, folder: str, asked: list[str], id_type: str = "string") -> DataFrame:
    """The index of these words, in the form that ``build`` makes, with each row's
    length ``len``. Only the parts that hold one of them are read."""
    buckets = spark.read.parquet(f"{folder}/totals").agg(F.max("buckets")).first()[0]
    kept = spark.read.schema(f"id {id_type}, field string, term string, at array<int>, len long, {BUCKET} int").parquet(f"{folder}/postings")
    return opened(kept.where(F.col(BUCKET).isin(buckets_of(spark, asked, buckets))), asked)


def buckets_of(spark: SparkSession, asked: list[str], buckets: int = BUCKETS) -> list[int]:
    plain = spark.createDataFrame([(_plain(w),) for w in asked], "term string")  # the words of a question
    return sorted({r[0] for r in plain.select(bucket(F.col("term"), buckets)).collect()})


def opened(postings: DataFrame, asked: list[str]) -> DataFrame:
    return postings.where(F.col("term").isin([_plain(w) for w in asked])).select("id", "field", "term", F.explode("at").alias("pos"), "len")


def size_of(spark: SparkSession, folder: str) -> DataFrame:
    """docs and mean (their words) of a written index."""
    return mean_length(spark.read.parquet(f"{folder}/totals"))


def mean_length(totals: DataFrame) -> DataFrame:
    return totals.agg(F.sum("docs").alias("docs"), F.coalesce(F.try_divide(F.sum("words").cast("double"), F.sum("docs")), F.lit(1.0)).alias("mean"))


def ranked(index: DataFrame, query: list[str], found: DataFrame | None = None, limit: int | None = 50, size: DataFrame | None = None) -> DataFrame:
    """(id, score) by BM25 over the query's words, best first, ties by id. For a
    written index ``size`` has docs and mean."""
    wanted = [_plain(w) for w in query]
    matches = index.where(F.col("term").isin(wanted))
    if size is None:
        lengths = index.groupBy("id").agg(F.count("*").alias("len"))
        size = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
        tf = matches.groupBy("id", "term").agg(F.count("*").alias("tf")).join(lengths, "id")
    else:
        tf = matches.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
    joined = tf.join(F.broadcast(df), "term").join(F.broadcast(size.select("docs", "mean")))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = joined.groupBy("id").agg(F.sum(weight).alias("score"))
    if found is not None:
        scored = scored.join(found, "id", "left_semi")
    ordered = scored.orderBy(F.desc("score"), "id")
    return ordered if limit is None else ordered.limit(limit)
