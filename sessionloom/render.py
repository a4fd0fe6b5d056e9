"""Collected results as text: aligned table, JSON, CSV or Markdown."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame


def cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    return f"<{len(v)} bytes>" if isinstance(v, (bytes, bytearray)) else str(v)


def render(df: DataFrame, form: str = "table", most: int = 10_000) -> str:
    """At most ``most`` rows, as this is for people; a table or Markdown says so
    where more are left out, JSON and CSV raise an error."""
    names, rows = df.columns, [tuple(r) for r in df.limit(most + 1).collect()]
    rest = ""
    if len(rows) > most:
        if form in ("json", "csv"):
            raise ValueError(f"more than {most} rows: write them with Spark instead")
        rows, rest = rows[:most], f"\n(only the first {most} rows are shown)"
    if form == "json":
        plain = [{k: v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for k, v in zip(names, r, strict=True)} for r in rows]
        return json.dumps(plain, indent=2, ensure_ascii=False)
    texts = [[cell(v) for v in r] for r in rows]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([names, *texts])
        return out.getvalue()
    if form == "markdown":
        line = lambda xs: "| " + " | ".join(x.replace("|", "\\|") for x in xs) + " |"
        return "\n".join([line(names), "|" + "---|" * len(names), *map(line, texts)]) + rest
    if not rows:
        return "(no results)"
    width = [max(len(x) for x in col) for col in zip(names, *texts, strict=True)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, width, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, texts)]) + rest
