"""Column functions over telemetry events: projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL_END = ("PostToolUse", "PostToolUseFailure")


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to a timestamp; anything else is null."""
    return F.try_to_timestamp(text)


def event_date(text: Column) -> Column:
    return F.to_date(parse_ts(text))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end (ISO texts), cut towards zero."""
    return div(F.unix_micros(parse_ts(end)) - F.unix_micros(parse_ts(start)), 1000)


def div(x: Column, by: int) -> Column:
    """Integer division, cut towards zero."""
    return F.call_function("div", x, F.lit(by))


def event_hash(session_id: Column, event_type: Column, ts: Column, tool_use_id: Column, given: Column | None = None) -> Column:
    """16 hex digits that name an event; a hash on the wire wins."""
    joined = F.concat(*[x for c in (session_id, event_type, ts, tool_use_id) for x in (F.coalesce(c, F.lit("")), F.lit("|"))][:-1])
    made = F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)
    return made if given is None else F.coalesce(given, made)


def truthy(json: Column, key: str) -> Column:
    """1 where a JSON field is true or a non-zero integer, else 0."""
    raw = F.get_json_object(json, f"$.{key}")
    return F.when((raw == "true") | F.coalesce(raw.rlike(r"^-?[0-9]+$") & ~raw.rlike(r"^-?0+$"), F.lit(False)), 1).otherwise(0).cast("long")


def isolate(event_type: Column, value: Column, only: str) -> Column:
    """A field that counts on one event type only; empty is null."""
    return F.when(event_type == only, F.nullif(value, F.lit("")))


def slash_command(event_type: Column, prompt: Column) -> Column:
    return F.when((event_type == "UserPromptSubmit") & prompt.startswith("/"), 1).otherwise(0).cast("long")


def skill_path(text: Column) -> Column:
    """Fixed value: the folder under which skills are kept."""
    return F.nullif(F.regexp_extract(text, r"(?i)\.claude/skills/([^\s\"']+)", 1), F.lit(""))


def skill_name(text: Column) -> Column:
    """Last path part of the first skill path in a text, without extension."""
    return F.nullif(F.regexp_replace(F.element_at(F.split(skill_path(text), "/"), -1), r"(?<=.)\.[^.]*$", ""), F.lit(""))


def skill_type(text: Column) -> Column:
    path = F.lower(skill_path(text))
    return F.when(path.contains("agents"), "agent").when(path.contains("project"), "project").when(path.contains("system"), "system")


def stored_prompt_length(length: Column, prompt: Column) -> Column:
    return F.coalesce(length, F.octet_length(prompt).cast("long"))


def normalize_ts(text: Column) -> Column:
    """Microseconds and +00:00 instead of Z; other offsets and texts that are no
    timestamp stay as they are."""
    head = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|\+00:00)?$", 1)
    digits = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|\+00:00)?$", 2)
    return F.when(head == "", text).otherwise(F.concat(F.replace(head, F.lit(" "), F.lit("T")), F.lit("."), F.substring(F.rpad(digits, 6, "0"), 1, 6), F.lit("+00:00")))


def fmt_duration(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), "")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.format_string("%.1fs", ms / 1000.0))
        .otherwise(F.concat(div(ms, 60000).cast("string"), F.lit("m"), div(ms % 60000, 1000).cast("string"), F.lit("s")))
    )


def fmt_bytes(n: Column) -> Column:
    return F.when(n.isNull(), "").when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.format_string("%.1fK", n / 1024.0)).otherwise(F.format_string("%.1fM", n / float(1 << 20)))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def short_ts(text: Column) -> Column:
    return F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" "))


LEVELS = " ▁▂▃▄▅▆▇█"


def spark_level(value: Column, most: Column) -> Column:
    """One of nine bar characters for value of most; a maximum of 0 counts as 1."""
    top = F.when(most == 0, 1.0).otherwise(most.cast("double"))
    return F.substring(F.lit(LEVELS), F.least(F.lit(9), (F.floor(value / top * 8) + 1).cast("int")), F.lit(1))


def parent_dir(path: Column) -> Column:
    """All before the last slash (the root for what lies in it); null where
    there is nothing."""
    return F.when(path.rlike(r"^/[^/]+$"), "/").when(path.contains("/"), F.nullif(F.regexp_replace(path, r"/[^/]*$", ""), F.lit("")))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.transform(above, lambda p: F.when(p == "", "/").otherwise(p)))


def days_to_date(days: Column) -> Column:
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")


def any_case_like(text: Column, pattern: str) -> Column:
    return F.lower(text).like(pattern.lower())


def with_projections(events: DataFrame) -> DataFrame:
    """Isolated fields, flags, byte counts and hash of each event."""
    et = F.col("event_type")
    return events.withColumns(
        {
            "config_source": isolate(et, F.col("source"), "ConfigChange"),
            "source": isolate(et, F.col("source"), "SessionStart"),
            "reason": isolate(et, F.col("reason"), "SessionEnd"),
            "compact_trigger": isolate(et, F.col("compact_trigger"), "PreCompact"),
            "task_id": isolate(et, F.col("task_id"), "TaskCompleted"),
            "is_slash_command": slash_command(et, F.col("prompt_text")),
            "skill_name": skill_name(F.coalesce("skill_input", "tool_input")),
            "skill_type": skill_type(F.coalesce("skill_input", "tool_input")),
            "input_bytes": F.coalesce(F.octet_length("tool_input"), F.lit(0)).cast("long"),
            "output_bytes": F.coalesce(F.octet_length("tool_result"), F.lit(0)).cast("long"),
            "event_hash": event_hash(F.col("session_id"), et, F.col("timestamp"), F.col("tool_use_id")),
        }
    )
