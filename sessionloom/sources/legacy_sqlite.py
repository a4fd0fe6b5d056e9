"""Events of an older SQLite file, which all machines must be able to open. Tasks
read it by ranges of row numbers, whole."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS = 50_000  # of one task
# Columns of the old table and the payload fields that they become.
FIELDS = {"event_type": "hook_event_name", "session_id": "session_id", "tool_name": "tool_name", "tool_use_id": "tool_use_id", "tool_input": "tool_input", "cwd": "cwd"}
LINES = "source_file string, raw_index long, raw_line string"


def _opened(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.row_factory = sqlite3.Row
    return con


def read_events(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """Lines of v1 envelopes, nulls left out; raw_index is the row's number."""

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            with _opened(path) as con:
                yield pd.DataFrame([tuple(con.execute("SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM events").fetchone())], columns=["low", "high"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in part["id"].tolist():
                with _opened(path) as con:
                    found = con.execute("SELECT rowid AS raw_index, * FROM events WHERE rowid >= ? AND rowid < ?", (at, at + rows))
                    made = [(path, r["raw_index"], _line(dict(r))) for r in found]
                yield pd.DataFrame(made, columns=["source_file", "raw_index", "raw_line"])

    low, high = spark.range(1).mapInPandas(bounds, "low long, high long").first()
    return spark.range(low, high + 1, rows, max(1, -(-(high + 1 - low) // rows))).mapInPandas(read, LINES)


def _line(row: dict) -> str:
    return json.dumps({"v": 1, "ts": row.get("timestamp") or "", "p": {new: row[old] for old, new in FIELDS.items() if row.get(old) is not None}})
