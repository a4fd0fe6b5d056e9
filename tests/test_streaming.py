import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import live
from sessionloom.plans.catalog import Tables
from sessionloom.sources import jsonl
from sessionloom.store import Store
from sessionloom.streaming import jobs


@pytest.fixture
def spark(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def streamed(spark, df, path, files=3):
    df.repartition(files).write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_daily_counts_equal_the_batch(spark, sf, tmp_path):
    raw = Tables(spark, sf).raw.select("timestamp", "event_type")
    got = run(jobs.daily_counts(streamed(spark, raw, tmp_path), "60 days"), "daily", "complete")
    want = raw.groupBy(F.substring("timestamp", 1, 10).alias("day"), "event_type").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_across_batches(spark, tmp_path):
    rows = [("2026-01-01T00:00:00Z", f"h{i % 10}") for i in range(40)]
    df = spark.createDataFrame(rows, "timestamp string, event_hash string")
    assert run(jobs.deduplicated(streamed(spark, df, tmp_path, 4)), "dedup").count() == 10


def test_gate_equals_the_batch(spark, tmp_path):
    e = lambda i, s, who, path, tool="Edit": ("PreToolUse", s, who, tool, path, f"t{i:02d}", i)
    rows = [e(0, "s", "worker", "/a/x"), e(1, "s", "search", "/a/y", "Read"), e(2, "s", "worker", "/a/z"), e(3, "s", "worker", "/b/z"), e(4, "s", "worker", "/b/z"), e(5, "q", "worker", "/b/z"), e(6, "q", "search", "/c", "Grep"), e(7, "q", "worker", "/b/z")]
    df = spark.createDataFrame(rows, "event_type string, session_id string, agent_type string, tool_name string, file_path string, timestamp string, raw_index long")
    got = run(jobs.gate(streamed(spark, df, tmp_path, 1)), "gate")
    want = live.gate(df)
    assert {(r.raw_index, r.decision) for r in got.collect()} == {(r.raw_index, r.decision) for r in want.collect()}


def test_gate_starts_from_a_table(spark, tmp_path):
    """After half of the events as a table, the other half is decided as by one run over all."""
    r = random.Random(5)
    rows = [("PreToolUse", r.choice("pqs"), r.choice(["worker", "search", "other"]), r.choice(["Edit", "Read", "Grep"]), r.choice(["/", "/a/", "/a/b/", "c/", ""]) + r.choice("xyz"), f"t{i:03d}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "event_type string, session_id string, agent_type string, tool_name string, file_path string, timestamp string, raw_index long")
    early, late = df.where("raw_index < 60"), df.where("raw_index >= 60")
    got = run(jobs.gate(streamed(spark, late, tmp_path, 1), jobs.gate_state(early)), "gate_from_table")
    want = live.gate(df).where("raw_index >= 60")
    found = {(r.raw_index, r.decision) for r in got.collect()}
    assert found == {(r.raw_index, r.decision) for r in want.collect()}
    assert {d for _, d in found} == {"warn", "allow"}


def test_gate_forgets(spark, tmp_path):
    """State goes after its time: a warning is not held back by an old one, and without an active explorer there is none."""
    e = lambda i, who, path, tool="Edit": ("PreToolUse", "s", who, tool, path, f"t{i:02d}", i)
    schema = "event_type string, session_id string, agent_type string, tool_name string, file_path string, timestamp string, raw_index long"
    folder = str(tmp_path / "in")
    spark.createDataFrame([e(0, "search", "/a/x", "Read"), e(1, "worker", "/b/x")], schema).write.parquet(folder)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    found = {}
    for keep in (1000, 10**8):
        out = str(tmp_path / f"out{keep}")

        def step(keep=keep, out=out):
            stream = jobs.gate(spark.readStream.schema(schema).parquet(folder), keep_ms=keep)
            stream.writeStream.format("parquet").option("checkpointLocation", out + "_at").trigger(availableNow=True).start(out).awaitTermination()

        step()
        time.sleep(1.5)
        spark.createDataFrame([e(10 + len(found), "worker", "/c/x")], schema).write.mode("append").parquet(folder)
        step()
        found[keep] = {r.raw_index: r.decision for r in spark.read.parquet(out).collect()}
    assert found == {1000: {1: "warn", 10: "allow"}, 10**8: {1: "warn", 10: "warn", 11: "allow"}}


def test_tail_sees_appended_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("old\n")
    q = jobs.tail(spark, str(path)).writeStream.format("memory").queryName("tail").trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        with path.open("a") as f:
            f.write("one\n\nhalf")
        q.processAllAvailable()
        assert [(r.raw_index, r.raw_line) for r in spark.table("tail").collect()] == [(1, "one")]
        with path.open("a") as f:
            f.write(" a line\n")
        q.processAllAvailable()
        assert {r.raw_line for r in spark.table("tail").collect()} == {"one", "half a line"}
    finally:
        q.stop()
    shown = jsonl.tail_lines(spark.table("tail"))
    assert all(r.shown.startswith("[malformed]") for r in shown.collect())


def test_ingest_of_new_files(spark, tmp_path):
    logs, store = tmp_path / "logs", Store(spark, str(tmp_path / "store"))
    logs.mkdir()
    line = lambda s: json.dumps({"v": 1, "ts": "2026-01-01T00:00:00Z", "p": {"hook_event_name": "Stop", "session_id": s}}) + "\n"
    (logs / "hook_logs_2026-01-01.jsonl").write_text(line("a") + line("b"))
    go = lambda: jobs.ingest_available(spark, str(logs), store, str(tmp_path / "check")).awaitTermination()
    go()
    assert store.table("sessions").count() == 2
    (logs / "hook_logs_2026-01-02.jsonl").write_text(line("c"))
    go()
    assert store.table("sessions").count() == 3 and store.table("lines").count() == 3
    before = store.current()
    go()
    assert store.current() == before
