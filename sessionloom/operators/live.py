"""Answers over recent log events without the tables: coverage of an agent,
provenance of edits, and the coverage gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import events as E

# Names of agents and tools in the logs.
EXPLORERS = ("search", "ast-search", "lsp-search")
WORKER = "worker"
READS = ("Read", "NotebookRead")
EDITS = ("Edit", "Write", "MultiEdit")


def coverage(events: DataFrame, agent_id: str) -> DataFrame:
    """(kind, item) of an agent: files read, their directories, and a numbered
    stand-in for each different glob and grep pattern."""
    own = events.where(F.col("agent_id") == agent_id)
    reads = own.where(F.col("tool_name").isin(*READS) & F.col("file_path").isNotNull()).select("file_path").distinct()
    out = reads.select(F.lit("read").alias("kind"), F.col("file_path").alias("item"))
    out = out.unionByName(reads.select(F.lit("dir").alias("kind"), E.parent_dir(F.col("file_path")).alias("item")).where("item IS NOT NULL").distinct())
    counts = own.where(F.col("tool_name").isin("Glob", "Grep")).groupBy(F.lower("tool_name").alias("kind")).agg(F.count_distinct("pattern").alias("n"))
    numbered = counts.where("n > 0").select("kind", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return out.unionByName(numbered.select("kind", F.format_string("<redacted:%d>", "i").alias("item")))


def truncated(tool_input: Column) -> Column:
    """Whether an input is a marker for one that was cut (an object with a field
    _t or _b)."""
    v = F.try_parse_json(tool_input)
    return F.coalesce(tool_input.contains('"_') & (F.try_variant_get(v, "$._t", "variant").isNotNull() | F.try_variant_get(v, "$._b", "variant").isNotNull()), F.lit(False))


def touched(events: DataFrame) -> DataFrame:
    """Distinct (session_id, file_path) with flags for who touched it how."""
    kept = events.where((F.col("event_type") == "PreToolUse") & (F.col("file_path") != "") & (F.col("session_id") != ""))
    if "tool_input" in events.columns:
        kept = kept.where(~truncated(F.col("tool_input")))
    explorer, worker = F.col("agent_type").isin(*EXPLORERS), F.col("agent_type") == WORKER
    reads, edits = F.col("tool_name").isin(*READS), F.col("tool_name").isin(*EDITS)
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return kept.where(F.col("agent_type").isNotNull() & F.col("tool_name").isNotNull()).groupBy("session_id", "file_path").agg(flag(explorer & reads).alias("explored"), flag(worker & reads).alias("read"), flag(worker & edits).alias("edited"))


def provenance_sessions(events: DataFrame) -> DataFrame:
    """Per session: files explorers and workers read, the share of the workers'
    that explorers had read, files edited, and those nobody explored."""
    n = F.count_if
    made = touched(events).groupBy("session_id").agg(
        n("explored").alias("explorer_read_count"), n("read").alias("worker_read_count"), n(F.col("explored") & F.col("read")).alias("_both"), n("edited").alias("worker_edit_count"), n(F.col("edited") & ~F.col("explored")).alias("coverage_edge_incidents")
    )
    overlap = F.when((F.col("explorer_read_count") > 0) & (F.col("worker_read_count") > 0), F.col("_both") / F.col("worker_read_count"))
    return made.select("session_id", "explorer_read_count", "worker_read_count", overlap.alias("reexploration_overlap"), "worker_edit_count", "coverage_edge_incidents")


def provenance_total(events: DataFrame) -> DataFrame:
    return provenance_sessions(events).agg(
        F.count("reexploration_overlap").alias("sessions_with_both"),
        F.round(F.avg("reexploration_overlap"), 4).alias("mean_reexploration_overlap"),
        F.coalesce(F.sum("worker_edit_count"), F.lit(0)).alias("total_worker_edits"),
        F.coalesce(F.sum("coverage_edge_incidents"), F.lit(0)).alias("total_coverage_edge_incidents"),
    )


def gate(events: DataFrame) -> DataFrame:
    """Every worker event on a file with the decision that the coverage gate
    takes: ``warn`` for the first worker event of a session on a file that no
    explorer of that session had looked at before, nor any file of a directory
    above it, provided that some explorer had been active; else ``allow``."""
    pre = events.where((F.col("event_type") == "PreToolUse") & (F.col("file_path") != "") & (F.col("session_id") != ""))
    at = F.struct("timestamp", "raw_index")
    seen = pre.where(F.col("agent_type").isin(*EXPLORERS) & F.col("tool_name").isin(*READS, "Glob", "Grep"))
    began = seen.groupBy("session_id").agg(F.min(at).alias("active"))
    files = seen.groupBy("session_id", F.col("file_path").alias("path")).agg(F.min(at).alias("t"))
    dirs = seen.select("session_id", E.parent_dir(F.col("file_path")).alias("path"), at.alias("t")).where("path IS NOT NULL").groupBy("session_id", "path").agg(F.min("t").alias("t"))
    # a file is covered by itself or by a covered directory that is one of its ancestors: an equality join on ancestors
    work = pre.where(F.col("agent_type") == WORKER).select("session_id", "file_path", "timestamp", "raw_index", at.alias("at"))
    targets = work.select("session_id", "file_path").distinct()
    own = targets.join(files.withColumnRenamed("path", "file_path"), ["session_id", "file_path"]).select("session_id", "file_path", "t")
    above = targets.withColumn("path", F.explode(E.ancestors(F.col("file_path")))).join(dirs, ["session_id", "path"]).select("session_id", "file_path", "t")
    covered = own.unionByName(above).groupBy("session_id", "file_path").agg(F.min("t").alias("covered"))
    judged = work.join(covered, ["session_id", "file_path"], "left").join(began, "session_id", "left")
    open_ = F.coalesce(F.col("active") < F.col("at"), F.lit(False)) & ~F.coalesce(F.col("covered") < F.col("at"), F.lit(False))
    first = F.row_number().over(W.partitionBy("session_id", "file_path").orderBy(F.desc("open"), "timestamp", "raw_index"))
    ranked = judged.withColumn("open", open_).withColumn("_r", first)
    return ranked.select("session_id", "file_path", "timestamp", "raw_index", F.when(F.col("open") & (F.col("_r") == 1), "warn").otherwise("allow").alias("decision"))
