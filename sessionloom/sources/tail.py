"""A streaming source of lines appended to a growing log file: Spark's file source
reads a file once and sees nothing that is appended to it."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TailSource(DataSource):
    """``spark.readStream.format("log_tail").option("path", …)``; option
    ``from`` is ``end`` (default: only new lines) or ``start``. A line counts once
    its newline is there. One growing file is one user's log: it is read by one
    reader, at most ``max_bytes`` a batch."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source_file string, raw_index long, raw_line string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.from_end = options["path"], options.get("from", "end") == "end"
        self.max_bytes = int(options.get("max_bytes", 8 << 20))

    def initialOffset(self) -> dict:
        at = line = 0
        if self.from_end and os.path.exists(self.path):
            with open(self.path, "rb") as f:
                for raw in f:
                    if raw.endswith(b"\n"):
                        at, line = at + len(raw), line + 1
        return {"byte": at, "line": line}

    def _read(self, start: dict, most: int) -> tuple[list[tuple[str, int, str]], dict]:
        if not os.path.exists(self.path):
            return [], start
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            data = f.read(most)
            while data and b"\n" not in data and (more := f.read(most)):
                data += more  # one line longer than a batch
        whole = data[: data.rfind(b"\n") + 1]
        lines = whole.split(b"\n")[:-1]
        rows = [(os.path.basename(self.path), start["line"] + i, x.decode("utf-8", "replace")) for i, x in enumerate(lines) if x.strip()]
        return rows, {"byte": start["byte"] + len(whole), "line": start["line"] + len(lines)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._read(start, self.max_bytes)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._read(start, end["byte"] - start["byte"])[0])
