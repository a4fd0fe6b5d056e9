"""Exact JSON text: compact, ASCII only, keys in wire order or sorted. Spark's own
printers change number texts and leave other letters as they are, so these few
go through Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXPONENT = re.compile(r"e([+-])0*(\d)")


def number(x: int | float) -> str:
    if isinstance(x, int) and -(1 << 63) <= x < 1 << 64:
        return str(x)
    return _EXPONENT.sub(lambda m: "e" + m[1].replace("+", "") + m[2], repr(float(x)))


def text(x: str) -> str:
    return json.dumps(x).replace("\x7f", "\\u007f")


def dump(value, ordered: bool = False) -> str:
    if isinstance(value, dict):
        items = sorted(value.items()) if ordered else value.items()
        return "{" + ",".join(f"{text(k)}:{dump(v, ordered)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(dump(v, ordered) for v in value) + "]"
    if isinstance(value, str):
        return text(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return number(value)


def _load(raw):
    """The parsed value in a list, or nothing where the text is no JSON."""
    try:
        return [json.loads(raw)] if raw is not None else []
    except ValueError:
        return []


@F.pandas_udf(T.StringType())
def compact(raw: pd.Series) -> pd.Series:
    """A JSON text, compact and in wire order; null where it is no JSON."""
    return raw.map(lambda r: next((dump(v) for v in _load(r)), None))


@F.pandas_udf(T.StringType())
def canonical(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: next((dump(v, True) for v in _load(r)), None))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stored_fields(raw: pd.Series, names: pd.Series) -> pd.Series:
    """Of the payload of a log line, for each of the comma-separated fields: its
    value, a string as it is and else compact JSON; null where it is absent or
    null. A null line gives null."""

    def of(r, ns):
        payload = next((v.get("p") for v in _load(r) if isinstance(v, dict)), None)
        payload = payload if isinstance(payload, dict) else {}
        values = [payload.get(n) for n in ns.split(",")]
        return [v if v is None or isinstance(v, str) else dump(v) for v in values]

    return pd.Series([None if r is None else of(r, ns) for r, ns in zip(raw, names, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x == y or (bool(v := _load(x)) and bool(w := _load(y)) and dump(v[0], True) == dump(w[0], True)) for x, y in zip(a, b, strict=True)], dtype=object)


def equal(a: Column, b: Column) -> Column:
    """Equal texts or equal JSON values; key order does not matter, 2 is not 2.0."""
    return F.when(a.eqNullSafe(b), True).when(a.isNull() | b.isNull(), False).otherwise(_same(a, b))
