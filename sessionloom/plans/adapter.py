"""The benchmark table ``events`` seen as session telemetry.

One deterministic view, ``tev``, in both dialects: a session is a user's ISO
week, event types and their fields follow from the raw type and a number in the
JSON column. Everything that the engine derives (sequence numbers, durations,
session and tool-call rows) starts from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31"  # the data end on 2024-01-30

_TEMPLATE = """
SELECT concat('hook_logs_', substr({iso}, 1, 10), '.jsonl') AS source_file, event_id AS raw_index, {iso} AS timestamp, session_id, event_type,
  CASE WHEN event_type IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure') AND k % 17 > 0 THEN concat('t', CAST(k % 5 AS {str})) END AS tool_use_id,
  CASE WHEN event_type NOT IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure') THEN NULL
       WHEN k % 6 = 0 THEN 'Read' WHEN k % 6 = 1 THEN 'Edit' WHEN k % 6 = 2 THEN 'Bash' WHEN k % 6 = 3 THEN 'Grep' WHEN k % 6 = 4 THEN 'Glob' ELSE 'Write' END AS tool_name,
  CASE k % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'worker' WHEN 2 THEN 'reviewer' ELSE NULL END AS agent_type,
  CASE WHEN k % 8 = 7 THEN NULL ELSE concat('a', CAST(k % 10 AS {str})) END AS agent_id,
  concat('/src/', CAST(k % 7 AS {str}), '/f', CAST(k % 20 AS {str}), '.py') AS file_path,
  concat('cfg', CAST(user_id % 3 AS {str})) AS config_version,
  CASE WHEN event_type = 'PreToolUse' THEN props END AS tool_input,
  CASE WHEN event_type = 'PostToolUse' THEN concat('r', CAST(CAST(floor(value * 100) AS BIGINT) AS {str})) END AS tool_result,
  CASE WHEN event_type = 'PostToolUseFailure' AND k % 3 > 0 THEN concat('error ', CAST(k AS {str})) END AS error,
  CASE WHEN event_type = 'UserPromptSubmit' THEN CASE WHEN k % 7 = 0 THEN concat('/run ', CAST(k AS {str})) ELSE concat('fix the café ', CAST(k AS {str})) END END AS prompt_text,
  CASE WHEN event_type = 'UserPromptSubmit' THEN k * 3 END AS prompt_length,
  CASE WHEN event_type = 'SessionStart' THEN CASE k % 3 WHEN 0 THEN 'startup' WHEN 1 THEN 'resume' ELSE 'compact' END WHEN event_type = 'Stop' THEN 'x' END AS source,
  CASE WHEN event_type = 'SessionEnd' THEN CASE k % 2 WHEN 0 THEN 'exit' ELSE 'logout' END WHEN k % 9 = 0 THEN '' END AS reason,
  CASE WHEN event_type = 'PreCompact' THEN CASE k % 2 WHEN 0 THEN 'auto' ELSE 'manual' END END AS compact_trigger,
  CASE WHEN event_type = 'TaskCompleted' THEN concat('task', CAST(k AS {str})) END AS task_id,
  concat('m', CAST(user_id % 2 AS {str})) AS model,
  concat('/proj/', CAST(user_id % 5 AS {str})) AS cwd,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('b', CAST(user_id % 4 AS {str})) END AS git_branch,
  CASE WHEN event_type = 'UserPromptSubmit' AND k % 6 = 0 THEN concat('cat ~/.claude/skills/', CASE k % 4 WHEN 0 THEN 'agents/review' WHEN 2 THEN 'system/format.md' ELSE 'x/build.v2.md' END) END AS skill_input,
  value, k, user_id, raw_type
FROM (
  SELECT *, CASE
    WHEN raw_type = 'signup' AND k % 5 = 4 THEN 'SessionEnd' WHEN raw_type = 'signup' AND k % 5 = 3 THEN 'PreCompact' WHEN raw_type = 'signup' THEN 'SessionStart'
    WHEN raw_type = 'view' AND k % 11 = 0 THEN 'SubagentStart' WHEN raw_type = 'view' AND k % 11 = 1 THEN 'Stop' WHEN raw_type = 'view' AND k % 11 = 2 THEN 'TaskCompleted'
    WHEN raw_type = 'view' AND k % 11 = 3 THEN 'PermissionRequest' WHEN raw_type = 'view' THEN 'UserPromptSubmit'
    WHEN raw_type = 'click' THEN 'PreToolUse' WHEN raw_type = 'purchase' THEN 'PostToolUse' ELSE 'PostToolUseFailure' END AS event_type
  FROM (
    SELECT event_id, ts, user_id, event_type AS raw_type, value, props, {k} AS k,
      concat('u', CAST(user_id AS {str}), '-', {week}) AS session_id
    FROM events) a) b
"""

_SPARK = _TEMPLATE.format(
    str="STRING",
    iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    k="CAST(get_json_object(props, '$.k') AS BIGINT)",
    week="date_format(date_trunc('week', ts), 'yyyyMMdd')",
).replace("FROM events)", "FROM {events})")

TEV = _TEMPLATE.format(
    str="VARCHAR",
    iso="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
    k="CAST(json_extract_string(props, '$.k') AS BIGINT)",
    week="strftime(date_trunc('week', ts), '%Y%m%d')",
)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


# Awkward log lines, made from the view's columns in both dialects: fields of wrong
# types, nulls, other letters, and the older formats.
PAYLOAD_LINE = """concat('{{"v":1,"ts":"', timestamp, '","p":{{"hook_event_name":"UserPromptSubmit","session_id":"', session_id, '","prompt_length":',
  CASE k % 5 WHEN 0 THEN CAST(k AS {str}) WHEN 1 THEN concat('"', CAST(k AS {str}), '"') WHEN 2 THEN 'null' WHEN 3 THEN '2.5' ELSE '{{}}' END,
  ',"is_interrupt":', CASE k % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '3' WHEN 3 THEN '"true"' WHEN 4 THEN 'null' ELSE '0' END,
  ',"tool_name":', CASE k % 3 WHEN 0 THEN '"Größe ☃"' WHEN 1 THEN '7' ELSE 'null' END,
  ',"tool_input":', CASE k % 4 WHEN 0 THEN '{{"b" : [1.50, 1e3, true], "é":null}}' WHEN 1 THEN '"plain é"' WHEN 2 THEN 'null' ELSE '[ ]' END, '}}}}')"""
LEGACY_LINE = """CASE k % 7 WHEN 0 THEN concat('{{"phase":"pre","timestamp":"', timestamp, '","session_id":"', session_id, '","tool":"Read","tool_use_id":"t', CAST(k AS {str}), '","input_summary":"é ', CAST(k AS {str}), '","cwd":"/p"}}')
  WHEN 1 THEN concat('{{"phase":"post","ts":"', timestamp, '","session_id":"', session_id, '","tool_name":"Edit","response_summary":null}}')
  WHEN 2 THEN concat('{{"event_type":"Odd","session_id":"', session_id, '","n":', CAST(k AS {str}), '}}')
  WHEN 3 THEN concat('{{"v":1,"ts":"', timestamp, '","p":{{"n":', CAST(k AS {str}), '}}}}')
  WHEN 4 THEN '{{"event_type":"NoSession"}}' WHEN 5 THEN '{{broken' ELSE concat('  {{"session_id":"', session_id, '"}} ') END"""
RAW_LINE = """CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN '  ' WHEN k % 9 = 2 THEN concat('café ☃ ', CAST(raw_index AS {str})) ELSE concat('{{"n":', CAST(raw_index AS {str}), '}}') END"""


def spark_text(template: str) -> str:
    return template.format(str="STRING")


def duck_text(template: str) -> str:
    return template.format(str="VARCHAR")


# (JSON text, compact, sorted); None where it is no JSON
JSON_SHAPES = [
    ('{"b" : 1, "a":[1 ,2.0]}', '{"b":1,"a":[1,2.0]}', '{"a":[1,2.0],"b":1}'),
    ('{"z":{"y":-0.0,"x":1e100},"é":"ñ☃"}', '{"z":{"y":-0.0,"x":1e100},"\\u00e9":"\\u00f1\\u2603"}', '{"z":{"x":1e100,"y":-0.0},"\\u00e9":"\\u00f1\\u2603"}'),
    ('[0.00001, 1.5e300 , 12345678901234567890]', '[1e-5,1.5e300,12345678901234567890]', '[1e-5,1.5e300,12345678901234567890]'),
    ('"tab\\t and \\u0041"', '"tab\\t and A"', '"tab\\t and A"'),
    ('{"a":{"c":[],"b":{}},"A":null}', '{"a":{"c":[],"b":{}},"A":null}', '{"A":null,"a":{"b":{},"c":[]}}'),
    ("{broken", None, None),
    ("", None, None),
    ("true", "true", "true"),
]
JSON_PAIRS = [('{"a":1,"b":[2]}', '{"b":[2],"a":1}', True), ("2", "2.0", False), ("x", "x", True), ('"é"', '"\\u00e9"', True), ("[1, 2]", "[1,2]", True), ("[1,2]", "[2,1]", False), ("{", "[", False)]


def picked(values: list, by: str = "k") -> str:
    """SQL in both dialects: the value that belongs to a row's number."""
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"
