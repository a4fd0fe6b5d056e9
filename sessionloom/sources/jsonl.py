"""Event logs: daily files of JSON lines, plain or gzip, with a dead letter for
every line that is no envelope."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.functions import json_text

LOG_NAME = re.compile(r"hook_logs_(\d{4}-\d\d-\d\d)\.jsonl(\.gz)?$", re.IGNORECASE)
# Where older versions kept their logs, below a home folder.
PROJECT_ROOTS = ("Projects", "projects", "code", "Code", "dev", "Dev", "workspace", "repos")
USER_LOGS = (".claude/logs", ".local/share/claude/logs")

# discovery


def log_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(date, path) of the daily logs of a folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path)]
    return sorted((m[1], p) for p in found if (m := LOG_NAME.search(p)))


def legacy_files(spark: SparkSession, home: str) -> list[str]:
    """Logs of older versions below a home folder: plain and packed ones of
    projects, plain ones of the user."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    patterns = [*[f"{home}/{root}/*/.claude/logs/*.{end}" for root in PROJECT_ROOTS for end in ("jsonl", "jsonl.gz")], *[f"{home}/{folder}/*.jsonl" for folder in USER_LOGS]]
    return list(dict.fromkeys(p for pattern in patterns for p in sorted(s.getPath().toString() for s in (fs.globStatus(path(pattern)) or []))))


def unprocessed(files: list[tuple[str, str]], today: str, include_today: bool = False) -> list[str]:
    return [p for d, p in files if d < today or (include_today and d == today)]


def of_day(files: list[tuple[str, str]], day: str) -> list[str]:
    """The logs of a day; a day without one has no lines, which is no error."""
    return [p for d, p in files if d == day]


def newest(files: list[tuple[str, str]], n: int) -> list[str]:
    return [p for _, p in files[::-1][:n]]


def last_days(files: list[tuple[str, str]], today: str, days: int) -> list[str]:
    first = (dt.date.fromisoformat(today) - dt.timedelta(days=days - 1)).isoformat()
    return [p for d, p in files if first <= d <= today]


def inventory(spark: SparkSession, folder: str, today: str) -> DataFrame:
    """Daily logs of a folder by state: how many, their bytes, first and last day.
    Today's is active, packed ones are archived, others are waiting."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(("active" if day >= today else "archived" if p.lower().endswith(".gz") else "waiting"), day, fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(p)).getLen()) for day, p in log_files(spark, folder)]
    listed = spark.createDataFrame(rows, "state string, day string, bytes long")
    return listed.groupBy("state").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).orderBy("state")


# lines


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, raw_index, raw_line): all lines but blank ones, with their
    number in the file, from 0, blank ones counted. Files may be split: numbers
    are the rank in a split plus the lines of the splits before it. A source_file
    is name@folder: logs of one name from several folders stay apart, and text
    order is that of the days in their names."""
    schema = "source_file string, raw_index long, raw_line string"
    if not paths:
        return spark.createDataFrame([], schema)
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = read.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    lines = read.join(offsets, ["file", "block"]).select(F.concat(F.substring_index("file", "/", -1), F.lit("@"), F.regexp_replace("file", "/[^/]*$", "")).alias("source_file"), (rank + F.col("offset")).alias("raw_index"), F.col("value").alias("raw_line"))
    return lines.where(F.trim("raw_line") != "")


def _typed(v: Column, path: str, kind: str) -> Column:
    """A field if it has that type, else null; no casts between types."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == kind, F.try_variant_get(v, path, {"STRING": "string", "BIGINT": "long", "BOOLEAN": "boolean"}[kind]))


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))


def _parsed_once(lines: DataFrame) -> DataFrame:
    """Adds j, the line as a variant. It comes out of a generator, below which no
    filter is pushed: as a plain column it would be parsed again in each."""
    return lines.select("*", F.explode(F.array(F.try_parse_json("raw_line"))).alias("j"))


def parse(lines: DataFrame) -> DataFrame:
    """Adds v, ts, h, j (the line as a variant) and error, null for envelopes."""
    j = F.col("j")
    whole = (_kind(j, "$.v") == "BIGINT") & (F.try_variant_get(j, "$.v", "long") >= 0) & (_kind(j, "$.ts") == "STRING") & (_kind(j, "$.p") != "ABSENT") & _kind(j, "$.h").isin("ABSENT", "VOID", "STRING")
    named = lambda k: F.coalesce(_typed(j, k, "STRING") != "", F.lit(False))
    error = (
        F.when(j.isNull() | ~F.coalesce(whole, F.lit(False)), F.lit("JSON parse error"))
        .when(~_kind(j, "$.p").startswith("OBJECT"), F.lit("payload is not a JSON object"))
        .when(~(named("$.p.hook_event_name") & named("$.p.session_id")), F.lit("missing hook_event_name or session_id"))
    )
    return _parsed_once(lines).withColumns({"ts": _typed(j, "$.ts", "STRING"), "h": _typed(j, "$.h", "STRING"), "error": error})


def envelopes(lines: DataFrame) -> DataFrame:
    return parse(lines).where("error IS NULL").drop("error")


def malformed(lines: DataFrame) -> DataFrame:
    return parse(lines).where("error IS NOT NULL").select("source_file", "raw_index", "raw_line", "error")


_TEXTS = "tool_name tool_use_id agent_id agent_type source reason model permission_mode cwd notification_type config_version git_branch git_commit skill_name skill_type task_id task_subject teammate_name error".split()


_PAYLOADS = ("tool_input", "tool_result", "tool_response")


def events(envelopes: DataFrame) -> DataFrame:
    """Payload fields as columns, ready for enrichment."""
    j, et = F.col("j"), F.col("event_type")
    get = lambda k: _typed(j, f"$.p.{k}", "STRING")
    truthy = lambda k: F.when(F.coalesce(_typed(j, f"$.p.{k}", "BOOLEAN"), F.lit(False)) | (F.coalesce(_typed(j, f"$.p.{k}", "BIGINT"), F.lit(0)) != 0), 1).otherwise(0).cast("long")
    base = envelopes.select(
        "source_file", "raw_index", "raw_line", F.col("ts").alias("timestamp"), get("hook_event_name").alias("event_type"), get("session_id").alias("session_id"), "h", "j",
        *[get(k).alias(k) for k in _TEXTS],
        get("trigger").alias("compact_trigger"),
        F.coalesce(get("prompt"), get("prompt_text")).alias("prompt_text"),
        _typed(j, "$.p.prompt_length", "BIGINT").alias("prompt_length"),
        _typed(j, "$.p.result_size", "BIGINT").alias("result_size"),
        truthy("is_interrupt").alias("is_interrupt"),
        truthy("stop_hook_active").alias("stop_hook_active"),
        F.when(_kind(j, "$.p.tool_input").startswith("OBJECT"), _typed(j, "$.p.tool_input.file_path", "STRING")).alias("file_path"),
        F.when(_kind(j, "$.p.tool_input").startswith("OBJECT"), _typed(j, "$.p.tool_input.pattern", "STRING")).alias("pattern"),
        *[_kind(j, f"$.p.{k}").alias(f"_kind_{k}") for k in _PAYLOADS],
        *[get(k).alias(f"_text_{k}") for k in _PAYLOADS],
    )
    # only values that are neither text nor null need their exact JSON text, which Python makes, once for each line
    plain = lambda k: F.col(f"_kind_{k}").isin("ABSENT", "VOID", "STRING")
    asked = F.when(~(plain("tool_input") & plain("tool_result") & plain("tool_response")), F.col("raw_line"))
    base = base.withColumn("_made", json_text.stored_fields(asked, F.lit(",".join(_PAYLOADS))))
    stored = {k: F.when(plain(k), F.col(f"_text_{k}")).otherwise(F.col("_made")[i]) for i, k in enumerate(_PAYLOADS)}
    size = lambda k: F.when(F.col(f"_kind_{k}") == "ABSENT", 0).when(F.col(f"_kind_{k}") == "VOID", 4).otherwise(F.octet_length(stored[k])).cast("long")
    # a result that is there, be it null, hides the other name
    named = lambda of: F.when(F.col("_kind_tool_result") != "ABSENT", of("tool_result")).otherwise(of("tool_response"))
    base = base.withColumns({"_in": stored["tool_input"], "_out": named(stored.get), "_in_bytes": size("tool_input"), "_out_bytes": named(size)})
    detected = lambda f: f(F.col("_in"))
    given = F.col("skill_name").isNotNull()
    made = base.withColumns(
        {
            "config_source": E.isolate(et, F.col("source"), "ConfigChange"),
            "source": E.isolate(et, F.col("source"), "SessionStart"),
            "reason": E.isolate(et, F.col("reason"), "SessionEnd"),
            "compact_trigger": E.isolate(et, F.col("compact_trigger"), "PreCompact"),
            **{k: E.isolate(et, F.col(k), "TaskCompleted") for k in ("task_id", "task_subject", "teammate_name")},
            "is_slash_command": E.slash_command(et, F.coalesce("prompt_text", F.lit(""))),
            "skill_name": F.when(given, F.col("skill_name")).otherwise(detected(E.skill_name)),
            "skill_type": F.when(given, F.col("skill_type")).otherwise(detected(E.skill_type)),
            "tool_input": F.col("_in"),
            "tool_result": F.col("_out"),
            "input_bytes": F.col("_in_bytes"),
            "output_bytes": F.col("_out_bytes"),
            "event_hash": E.event_hash(F.col("session_id"), et, F.col("timestamp"), F.col("tool_use_id"), F.col("h")),
        }
    )
    return made.drop("j", "h", *[c for c in made.columns if c.startswith("_")])


# other formats


def replay(lines: DataFrame) -> DataFrame:
    """The failed-events file for display: line from 1, ts, session_id, event_type
    (MALFORMED where it is no JSON) and the first 80 characters."""
    j = F.col("j")
    get = lambda p: F.coalesce(_typed(j, p, "STRING"), F.lit(""))
    return _parsed_once(lines).select(
        (F.col("raw_index") + 1).alias("line"),
        F.substring(get("$.ts"), 1, 19).alias("ts"),
        F.substring(get("$.p.session_id"), 1, 8).alias("session_id"),
        F.when(j.isNull(), "MALFORMED").otherwise(get("$.p.hook_event_name")).alias("event_type"),
        E.truncate(F.trim("raw_line"), 80).alias("raw"),
    )


def tail_lines(lines: DataFrame, only: str | None = None) -> DataFrame:
    """Lines for the eye: time, session, type in 25 columns, tool; ``only`` keeps
    those whose type or tool contains it, in any case (and malformed ones)."""
    j = F.col("j")
    get = lambda p: F.coalesce(_typed(j, p, "STRING"), F.lit(""))
    kind, tool = get("$.p.hook_event_name"), get("$.p.tool_name")
    shown = F.concat_ws("  ", F.substring(get("$.ts"), 1, 19), F.substring(get("$.p.session_id"), 1, 8), F.when(F.length(kind) < 25, F.rpad(kind, 25, " ")).otherwise(kind), tool)
    out = _parsed_once(lines).select(*lines.columns, F.when(j.isNull(), F.concat(F.lit("[malformed] "), F.substring(F.trim("raw_line"), 1, 80))).otherwise(shown).alias("shown"), (j.isNull() | F.lower(kind).contains((only or "").lower()) | F.lower(tool).contains((only or "").lower())).alias("_keep"))
    return out.where("_keep").drop("_keep")


def normalize_legacy(lines: DataFrame, now: str) -> DataFrame:
    """Lines of the older formats as envelopes: v1 lines pass; ``phase`` pre and
    post become tool events; other objects keep their fields if they name a
    session; what is no JSON object goes. Numbers count as their text, nulls as
    absent."""
    raw = F.col("raw_line")
    keys = ("v", "p", "ts", "timestamp", "phase", "session_id", "tool", "tool_name", "tool_use_id", "cwd", "input_summary", "response_summary", "event_type", "hook_event_name")
    j = F.from_json("raw_line", ", ".join(f"{k} string" for k in (*keys, "_bad")), {"columnNameOfCorruptRecord": "_bad"})
    trimmed = lines.withColumn("raw_line", F.trim("raw_line")).where(F.col("raw_line").startswith("{"))
    parsed = trimmed.select("*", F.explode(F.array(j)).alias("j"))  # parsed once, as in _parsed_once
    parsed = parsed.where("j._bad IS NULL").select("source_file", "raw_index", "raw_line", "j.*")
    either = F.coalesce
    ident = F.coalesce("tool_use_id", F.concat(F.lit("legacy_"), F.lower(F.hex(F.xxhash64(raw)))))
    text = lambda c: F.coalesce(c, F.lit(""))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    common = [text("session_id").alias("session_id"), text(either("tool", "tool_name")).alias("tool_name"), ident.alias("tool_use_id")]
    pre = F.struct(F.lit("PreToolUse").alias("hook_event_name"), *common, F.struct(text("input_summary").alias("_legacy_summary")).alias("tool_input"), text("cwd").alias("cwd"))
    post = F.struct(F.lit("PostToolUse").alias("hook_event_name"), *common, text("response_summary").alias("tool_response"), text("cwd").alias("cwd"))
    # all fields, with the event's name put in front; an older name field steps aside
    rest = F.replace(F.substring(raw, 2, 1 << 30), F.lit('"hook_event_name"'), F.lit('"_hook_event_name"'))
    name = F.coalesce(either("event_type", "hook_event_name"), F.lit("UnknownEvent"))
    other = F.concat(F.lit('{"hook_event_name":'), quoted(name), F.lit(","), rest)
    payload = F.when(F.col("phase") == "pre", F.to_json(pre)).when(F.col("phase") == "post", F.to_json(post)).when(text("session_id") != "", other)
    v1 = F.col("v").isNotNull() & F.col("p").isNotNull() & F.col("ts").isNotNull()
    line = F.concat(F.lit('{"v":1,"ts":'), quoted(F.coalesce(either("timestamp", "ts"), F.lit(now))), F.lit(',"p":'), payload, F.lit("}"))
    made = F.explode(F.array(F.when(v1, raw).otherwise(line))).alias("raw_line")
    return parsed.select("source_file", "raw_index", made).where("raw_line IS NOT NULL")
