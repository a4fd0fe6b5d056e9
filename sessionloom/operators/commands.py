"""The questions that users ask of the tables events, sessions and tool_calls.
Each is a lazy DataFrame; ``now`` (a date) is always given, never read from a
clock, and every limit has a unique order before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.operators import enrich as N


def since(column: str, now: str, days: int) -> Column:
    return E.event_date(F.col(column)) >= F.date_sub(F.to_date(F.lit(now)), days)


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The first session whose id starts with the prefix, in any case."""
    return sessions.where(E.any_case_like(F.col("session_id"), prefix + "%")).orderBy("session_id").limit(1)


def failure_rate(ok: str = "succeeded") -> Column:
    return F.round(F.lit(100.0) * F.count_if(F.col(ok) == 0) / F.count("*"), 1)


def summary(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Daily sessions, calls, failures, prompts, subagents, config versions."""
    day = E.event_date(F.col("started_at"))
    kept = sessions.where(since("started_at", now, days)).withColumn("date", F.date_format(day, "yyyy-MM-dd"))
    totals = {"tool_calls": "total_tool_calls", "failures": "total_failures", "prompts": "total_prompts", "subagents": "total_subagents"}
    return kept.groupBy("date").agg(F.count_distinct("session_id").alias("sessions"), *[F.sum(c).alias(k) for k, c in totals.items()], F.count_distinct("config_version").alias("config_versions")).orderBy(F.desc("date"))


def session_list(sessions: DataFrame, now: str, days: int = 30, cwd: str | None = None, branch: str | None = None, label: str | None = None, annotations: DataFrame | None = None, limit: int = 100) -> DataFrame:
    kept = sessions.where(since("started_at", now, days))
    if cwd is not None:
        kept = kept.where(E.any_case_like(F.col("cwd"), f"%{cwd}%"))
    if branch is not None:
        kept = kept.where(F.col("git_branch") == branch)
    if label is not None:
        kept = kept.join(annotations.where(F.col("label") == label), "session_id", "left_semi")
    return (
        kept.orderBy(F.desc("started_at"), "session_id")
        .limit(limit)
        .select("session_id", "started_at", E.millis_between(F.col("started_at"), F.col("ended_at")).alias("duration_ms"), F.col("total_tool_calls").alias("tool_calls"), F.col("total_failures").alias("failures"), "cwd", F.col("git_branch").alias("branch"), "chain_id", "source")
    )


TIMELINE = ("sequence_num", "timestamp", "event_type", "tool_name", "duration_ms", "agent_type", "skill_name", "error", "session_id")


def session_events(events: DataFrame, sessions: DataFrame, prefix: str) -> DataFrame:
    return events.join(F.broadcast(by_prefix(sessions, prefix).select("session_id")), "session_id", "left_semi").orderBy("sequence_num", "timestamp", "raw_index")


def session_timeline(events: DataFrame, sessions: DataFrame, prefix: str) -> DataFrame:
    return session_events(events, sessions, prefix).select(*TIMELINE)


def last_session(events: DataFrame, sessions: DataFrame) -> DataFrame:
    newest = sessions.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(1).select("session_id")
    return events.join(F.broadcast(newest), "session_id", "left_semi").orderBy("sequence_num", "timestamp", "raw_index").select(*TIMELINE)


def chain(sessions: DataFrame, prefix: str, include_root: bool = False) -> DataFrame:
    """Sessions of the chain of the session with this prefix. The root of a
    chain names it but is not in it unless ``include_root``."""
    one = F.broadcast(by_prefix(sessions, prefix).select(F.col("chain_id").alias("wanted")))
    match = F.col("chain_id") == F.col("wanted")
    if include_root:
        match = match | (F.col("session_id") == F.col("wanted"))
    found = sessions.join(one, match, "inner")
    return found.orderBy("started_at", "session_id").select("session_id", "started_at", "ended_at", F.col("total_tool_calls").alias("tool_calls"), F.col("total_failures").alias("failures"), F.col("total_prompts").alias("prompts"), F.col("git_branch").alias("branch"), "cwd", "chain_id")


def newest_version(sessions: DataFrame) -> DataFrame:
    """One row, the config_version of the newest session that has one."""
    return sessions.where("config_version IS NOT NULL").orderBy(F.desc_nulls_last("started_at"), "session_id").limit(1).select("config_version")


def tools(tool_calls: DataFrame) -> DataFrame:
    made = tool_calls.groupBy("tool_name").agg(F.count("*").alias("count"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"), failure_rate().alias("failure_rate"), F.sum("output_bytes").alias("total_bytes"))
    return made.orderBy(F.desc("count"), "tool_name")


def tools_current(tool_calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """As tools(), for calls of sessions with the newest config version; where no
    session has one, for all."""
    newest = F.broadcast(newest_version(sessions).agg(F.first("config_version").alias("newest")))  # one row, null where there is none
    ids = sessions.join(newest, F.col("newest").isNull() | (F.col("config_version") == F.col("newest"))).select("session_id")
    return tools(tool_calls.join(ids, "session_id", "left_semi"))


def agents(tool_calls: DataFrame) -> DataFrame:
    """By agent type; the average of calls per agent is weighted by calls."""
    per_agent = tool_calls.where("agent_id IS NOT NULL").groupBy("agent_id").agg(F.count("*").alias("per_agent"))
    joined = tool_calls.where("agent_type IS NOT NULL").join(per_agent, "agent_id", "left")
    made = joined.groupBy("agent_type").agg(F.count_distinct("agent_id").alias("instance_count"), F.avg("per_agent").alias("avg_tool_calls"), failure_rate().alias("failure_rate"), F.avg("duration_ms").alias("avg_duration_ms"))
    return made.orderBy(F.desc("instance_count"), "agent_type")


def skills(events: DataFrame, prefix: str | None = None) -> DataFrame:
    kept = events.where("skill_name IS NOT NULL")
    if prefix is not None:
        kept = kept.where(E.any_case_like(F.col("session_id"), prefix + "%"))
    made = kept.groupBy("skill_name", "skill_type").agg(F.count("*").alias("usage_count"), F.count_distinct("session_id").alias("sessions_count"), F.count_distinct("agent_type").alias("agent_types"))
    return made.orderBy(F.desc("usage_count"), "skill_name", "skill_type")


def failures(events: DataFrame, now: str, days: int = 7, limit: int = 200) -> DataFrame:
    kept = events.where((F.col("event_type") == "PostToolUseFailure") & since("timestamp", now, days))
    return kept.orderBy(F.desc("timestamp"), F.desc("raw_index")).limit(limit).select("timestamp", "session_id", "tool_name", "agent_type", "duration_ms", "error")


def before_stop(events: DataFrame, limit: int = 50, marker: str = "Stop") -> DataFrame:
    """The five events before each marker of a session, newest markers first."""
    label = F.concat("event_type", F.lit("/"), F.coalesce("tool_name", F.lit("")))
    found = N.lagged(events.select("session_id", "source_file", "sequence_num", "event_type", "timestamp", "raw_index", "tool_name"), label, 5, order=("source_file", "sequence_num"), wanted=F.col("event_type") == marker)
    newest = found.orderBy(F.desc("timestamp"), F.desc("raw_index")).limit(limit)
    return newest.select("session_id", "timestamp", *[F.try_element_at("before", F.lit(-k))["v"].alias(f"m{k}") for k in range(5, 0, -1)])


def compactions(events: DataFrame, limit: int = 100) -> DataFrame:
    kept = events.where(F.col("event_type") == "PreCompact")
    return kept.orderBy(F.desc("timestamp"), F.desc("raw_index")).limit(limit).select("session_id", "timestamp", "compact_trigger", "sequence_num", "git_branch", "context_cumulative_bytes")


def configs(sessions: DataFrame, config_versions: DataFrame) -> DataFrame:
    made = sessions.where("config_version IS NOT NULL").groupBy("config_version").agg(
        F.count_distinct("session_id").alias("sessions"), F.avg("total_tool_calls").alias("avg_tool_calls"), F.avg("total_failures").alias("avg_failures"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen")
    )
    named = made.join(config_versions.select(F.col("version_hash").alias("config_version"), F.col("description").alias("label")), "config_version", "left")
    return named.orderBy(F.desc("last_seen"), "config_version")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(f"{name}_count").alias("key"), "value") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chain_stats(sessions: DataFrame) -> DataFrame:
    sizes = sessions.where("chain_id IS NOT NULL").groupBy("chain_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("chains"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_chain_size"))


def top_tools(events: DataFrame, k: int = 5) -> DataFrame:
    """The k most used tools of each session, ties by name."""
    counts = events.where(F.col("tool_name") != "").groupBy("session_id", "tool_name").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("n"), "tool_name")))
    return ranked.where(F.col("rank") <= k)


METRICS = ("session_id", "started_at", "duration", "tool_calls", "failures", "prompts", "subagents", "top_tools", "cwd", "branch")


def session_stats(events: DataFrame) -> DataFrame:
    """The ten figures of session_diff() for every session, as text."""
    order = F.struct("source_file", "sequence_num", "timestamp")
    n = lambda t: F.count_if(F.col("event_type") == t).cast("string")
    base = events.groupBy("session_id").agg(
        F.min_by(F.struct("timestamp", "cwd", "git_branch"), order).alias("f"),
        F.coalesce(F.max_by("timestamp", F.when(F.col("event_type") == "SessionEnd", order)), F.max_by("timestamp", order)).alias("end"),
        n("PreToolUse").alias("tool_calls"),
        n("PostToolUseFailure").alias("failures"),
        n("UserPromptSubmit").alias("prompts"),
        n("SubagentStart").alias("subagents"),
    )
    most = top_tools(events).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tool_name", "n"))), lambda x: F.concat(x["tool_name"], F.lit(":"), x["n"].cast("string"))), ", ").alias("top_tools"))
    return base.join(most, "session_id", "left").select(
        F.col("session_id").alias("id"),
        E.short_id(F.col("session_id")).alias("session_id"),
        E.short_ts(F.col("f.timestamp")).alias("started_at"),
        E.fmt_duration(E.millis_between(F.col("f.timestamp"), F.col("end"))).alias("duration"),
        "tool_calls",
        "failures",
        "prompts",
        "subagents",
        F.coalesce("top_tools", F.lit("")).alias("top_tools"),
        F.coalesce("f.cwd", F.lit("")).alias("cwd"),
        F.coalesce("f.git_branch", F.lit("")).alias("branch"),
    )


def session_diff(events: DataFrame, sessions: DataFrame, a: str, b: str) -> DataFrame:
    """(ord, metric, a, b): two sessions side by side."""
    long = None
    for side, prefix in (("a", a), ("b", b)):
        own = events.join(F.broadcast(by_prefix(sessions, prefix).select("session_id")), "session_id", "left_semi")
        rows = session_stats(own).select(F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("ord", "x")).select("ord", "x.metric", F.lit(side).alias("side"), "x.v")
        long = rows if long is None else long.unionByName(rows)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("v"))).alias(s)
    return long.groupBy("ord", "metric").agg(pick("a"), pick("b")).orderBy("ord")


TRENDS = {
    "sessions": F.count_distinct,
    "tool_calls": F.sum,
    "failures": F.sum,
    "prompts": F.sum,
    "duration": F.avg,
}


def trends(sessions: DataFrame, metric: str, now: str, window: int = 14) -> DataFrame:
    """(date, value) by day, oldest first."""
    over = {"sessions": F.col("session_id"), "duration": E.millis_between(F.col("started_at"), F.col("ended_at"))}.get(metric, F.col(f"total_{metric}"))
    day = F.date_format(E.event_date(F.col("started_at")), "yyyy-MM-dd")
    kept = sessions.where(since("started_at", now, window)).withColumn("date", day)
    return kept.groupBy("date").agg(TRENDS[metric](over).cast("double").alias("value")).orderBy("date")


def sparkline(trend: DataFrame) -> DataFrame:
    """One row: a bar character for each day's value (days are few)."""
    top = trend.agg(F.max("value").alias("top"))
    levels = trend.join(F.broadcast(top)).select("date", E.spark_level(F.coalesce("value", F.lit(0.0)), F.coalesce("top", F.lit(0.0))).alias("bar"))
    return levels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "bar"))), lambda x: x["bar"]), "").alias("sparkline"))


def slow(tool_calls: DataFrame, threshold: int = 5000, tool: str | None = None, limit: int = 50) -> DataFrame:
    kept = tool_calls.where(F.col("duration_ms") > threshold)
    if tool is not None:
        kept = kept.where(F.col("tool_name") == tool)
    return kept.orderBy(F.desc("duration_ms"), "session_id", "tool_use_id").limit(limit).select("session_id", "tool_name", "agent_type", "duration_ms", "started_at", "error", "input_summary")


def tokens(sessions: DataFrame, prefix: str | None = None, limit: int = 20) -> DataFrame:
    """Bytes and a quarter of them as tokens: the largest, or by prefix."""
    made = sessions.select("session_id", "context_total_bytes", E.div(F.col("context_total_bytes"), 4).alias("est_tokens"), "started_at")
    if prefix is not None:
        return made.where(E.any_case_like(F.col("session_id"), prefix + "%")).orderBy(F.desc("started_at"), "session_id")
    return made.where("context_total_bytes > 0").orderBy(F.desc("context_total_bytes"), "session_id").limit(limit)


# The fields of an exported session, in order.
EXPORTED = ("session_id", "started_at", "ended_at", "total_tool_calls", "total_failures", "total_prompts", "total_subagents", "cwd", "git_branch", "git_commit", "chain_id", "config_version", "source", "model", "context_total_bytes")


def export(sessions: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Sessions of a range of days as one JSON text each, oldest first."""
    day, kept = E.event_date(F.col("started_at")), sessions
    if first is not None:
        kept = kept.where(day >= F.to_date(F.lit(first)))
    if last is not None:
        kept = kept.where(day <= F.to_date(F.lit(last)))
    present = [c for c in EXPORTED if c in sessions.columns]
    return kept.orderBy("started_at", "session_id").select(F.to_json(F.struct(*present), {"ignoreNullFields": "false"}).alias("value"))


def daily_totals(sessions: DataFrame, day: str) -> DataFrame:
    kept = sessions.where(E.event_date(F.col("started_at")) == F.to_date(F.lit(day)))
    return kept.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(f"total_{c}"), F.lit(0)).alias(c) for c in ("tool_calls", "failures", "prompts", "subagents")])


def before(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    return df.where(E.event_date(F.col(column)) < F.to_date(F.lit(cutoff)))


def keep_from(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """What pruning leaves: rows of unreadable dates stay."""
    return df.where(~F.coalesce(E.event_date(F.col(column)) < F.to_date(F.lit(cutoff)), F.lit(False)))


DATED = {"events": "timestamp", "sessions": "started_at", "tool_calls": "started_at"}


def prune_counts(tables: dict[str, DataFrame], cutoff: str) -> DataFrame:
    return table_counts({name: before(tables[name], column, cutoff) for name, column in DATED.items()})


def label_newest(sessions: DataFrame, config_versions: DataFrame, description: str, now: str) -> DataFrame:
    """config_versions with a description set for the newest version."""
    new = newest_version(sessions).select(F.col("config_version").alias("version_hash"), F.lit(now).alias("captured_at"), F.lit(description).alias("new"))
    joined = config_versions.select("version_hash", F.col("captured_at").alias("old_at"), "description").join(new, "version_hash", "full")
    return joined.select("version_hash", F.coalesce("old_at", "captured_at").alias("captured_at"), F.coalesce("new", "description").alias("description"))
