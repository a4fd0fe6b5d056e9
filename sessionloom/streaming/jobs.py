"""Structured Streaming forms: incremental ingest, deduplication, daily counts,
and the coverage gate with its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from sessionloom.functions import events as E
from sessionloom.operators import live
from sessionloom.operators.live import EXPLORERS, READS, WORKER
from sessionloom.sources.tail import TailSource
from sessionloom.store import Store


def ingest_available(spark: SparkSession, folder: str, store: Store, checkpoint: str, only: Callable[[str], bool] = lambda name: True) -> StreamingQuery:
    """Ingests the log files of a folder that no earlier run has, in one go; the
    checkpoint remembers them. ``only`` picks files by name."""

    def batch(df: DataFrame, _: int) -> None:
        paths = [r[0] for r in df.select("path").distinct().collect() if only(r[0].rpartition("/")[2])]
        if paths:
            store.ingest(paths)

    files = spark.readStream.format("text").option("pathGlobFilter", "hook_logs_*.jsonl*").load(folder).select(F.col("_metadata.file_path").alias("path"))
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(spark: SparkSession, path: str, start: str = "end") -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", path).option("from", start).load()


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One event of each hash among those that come within the delay."""
    return events.withColumn("at", E.parse_ts(F.col("timestamp"))).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_hash"])


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events by day and type; as agg_by_date for what is not later than delay."""
    timed = events.withColumn("at", E.parse_ts(F.col("timestamp"))).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n")


GATE_SCHEMA = "session_id string, file_path string, raw_index long, decision string"


class Gate(StatefulProcessor):
    """State of a session: what explorers covered, files warned about, and whether
    an explorer was active. With ``keep_ms`` each entry goes that long after it was
    last written."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file, self.dir, self.warned = (handle.getMapState(n, "path string", "seen boolean", self.keep_ms) for n in ("file", "dir", "warned"))
        self.active = handle.getValueState("active", "seen boolean", self.keep_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for kind, path in zip(initialState["kind"], initialState["path"], strict=True):
            getattr(self, kind).updateValue((path,), (True,))
        if (initialState["kind"] == "file").any():
            self.active.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows)).sort_values(["timestamp", "raw_index"])
        explores = todo["agent_type"].isin(EXPLORERS) & todo["tool_name"].isin([*READS, "Glob", "Grep"])
        works = todo["agent_type"] == WORKER
        decided = [self._decide(path) if work else self._cover(path) for path, work in zip(todo["file_path"][explores | works], works[explores | works], strict=True)]
        out = todo[works].assign(decision=[d for d in decided if d])
        yield out[["session_id", "file_path", "raw_index", "decision"]]

    def _cover(self, path: str) -> None:
        self.active.update((True,))
        self.file.updateValue((path,), (True,))
        parent = path.rpartition("/")[0] or ("/" if path.startswith("/") else "")
        if parent:
            self.dir.updateValue((parent,), (True,))

    def _decide(self, path: str) -> str:
        parts = path.split("/")
        above = {"/".join(parts[:n]) or "/" for n in range(1, len(parts) + 1)}
        if not self.active.exists() or self.file.containsKey((path,)) or any(self.dir.containsKey((d,)) for d in above if d) or self.warned.containsKey((path,)):
            return "allow"
        self.warned.updateValue((path,), (True,))
        return "warn"

    def close(self) -> None:
        pass


def _watched(events: DataFrame) -> DataFrame:
    kept = (F.col("event_type") == "PreToolUse") & (F.col("file_path") != "") & (F.col("session_id") != "")
    return events.where(kept).select("session_id", "file_path", "agent_type", "tool_name", "timestamp", "raw_index")


def gate_state(events: DataFrame) -> DataFrame:
    """What a gate knows after a table of events, a row for each session, kind
    (file, dir, warned) and path."""
    seen = _watched(events).where(F.col("agent_type").isin(*EXPLORERS) & F.col("tool_name").isin(*READS, "Glob", "Grep"))
    paths = F.array(F.struct(F.lit("file").alias("kind"), F.col("file_path").alias("path")), F.struct(F.lit("dir").alias("kind"), E.parent_dir(F.col("file_path")).alias("path")))
    covered = seen.select("session_id", F.inline(paths)).where("path IS NOT NULL")
    warned = live.gate(events).where("decision = 'warn'").select("session_id", F.lit("warned").alias("kind"), F.col("file_path").alias("path"))
    return covered.unionByName(warned).distinct()


def gate(events: DataFrame, state: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """Decisions of the coverage gate for a stream of events, as live.gate()
    takes them for a table; needs the RocksDB state store provider. ``state`` (of
    gate_state) is what a new query starts from. With ``keep_ms`` what a session was
    silent about for so long is forgotten; as time passes without input too, a query
    over what is available then ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off."""
    known = None if state is None else state.select("session_id", "kind", "path").groupBy("session_id")
    return _watched(events).groupBy("session_id").transformWithStateInPandas(statefulProcessor=Gate(keep_ms), outputStructType=GATE_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None", initialState=known)
