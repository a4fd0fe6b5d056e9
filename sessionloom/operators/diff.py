"""What differs between two versions of a table: rows on one side only, and
fields of common rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.functions import json_text


def _text(side: str, c: str, times: tuple[str, ...]) -> Column:
    value = F.col(f"{side}.{c}").cast("string")
    return E.normalize_ts(value) if c in times else value


def table_diff(a: DataFrame, b: DataFrame, key: list[str], json: tuple[str, ...] = (), times: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, field, a, b): kind is only_a, only_b or differs. Columns in
    ``json`` compare as values, those in ``times`` as normalised times."""
    fields = [c for c in a.columns if c not in (*key, *skip) and c in b.columns]
    side = lambda df, name: df.select(*key, F.struct(F.lit(1).alias("_here"), *fields).alias(name))
    joined = side(a, "a").join(side(b, "b"), key, "full")
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("key")
    lone = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b")
    none = F.lit(None).cast("string")
    sides = joined.where(lone.isNotNull()).select(name, lone.alias("kind"), none.alias("field"), none.alias("a"), none.alias("b"))
    common = joined.where(lone.isNull())
    found = []
    for c in fields:
        x, y = _text("a", c, times), _text("b", c, times)
        found.append(F.when(~(json_text.equal(x, y) if c in json else x.eqNullSafe(y)), F.struct(F.lit(c).alias("field"), x.alias("a"), y.alias("b"))))
    if not found:
        return sides
    differs = common.select(name, F.explode(F.filter(F.array(*found), lambda d: d.isNotNull())).alias("d")).select("key", F.lit("differs").alias("kind"), "d.field", "d.a", "d.b")
    return sides.unionByName(differs)


def events_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return table_diff(a, b, ["event_hash"], json=("tool_input", "tool_result", "raw_payload"), times=("timestamp",), skip=("id", "raw_line", "source_file"))


def sessions_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """chain_id follows from the parents and is not compared."""
    return table_diff(a, b, ["session_id"], times=("started_at", "ended_at"), skip=("chain_id",))


def tool_calls_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return table_diff(a, b, ["session_id", "tool_use_id"], times=("started_at", "completed_at"), skip=("id",))


def config_versions_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return table_diff(a, b, ["version_hash"], times=("captured_at",))


def annotations_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """A label given twice at one time is one row if its notes are equal."""
    return table_diff(a.distinct(), b.distinct(), ["session_id", "label", "created_at"])


def report(diff: DataFrame) -> DataFrame:
    """Counts by kind and field."""
    return diff.groupBy("kind", "field").agg(F.count("*").alias("n"))
