"""DuckDB statements that the queries are checked against. Every statement starts
from the same chain of common tables, built on the adapter's view."""

from __future__ import annotations

from sessionloom.plans.adapter import JSON_PAIRS, JSON_SHAPES, LEGACY_LINE, NOW, RAW_LINE, TEV, duck_text, picked

_MS = "((epoch_us(CAST({b} AS TIMESTAMP)) - epoch_us(CAST({a} AS TIMESTAMP))) // 1000)"


def ms(a: str, b: str) -> str:
    return _MS.format(a=a, b=b)


_PATH = r"nullif(regexp_extract(coalesce(skill_input, tool_input), '\.claude/skills/([^\s\"'']+)', 1, 'i'), '')"

CHAIN = f"""
WITH RECURSIVE tev AS MATERIALIZED ({TEV}),
proj AS (
  SELECT * REPLACE (
      CASE WHEN event_type = 'SessionStart' THEN nullif(source, '') END AS source,
      CASE WHEN event_type = 'SessionEnd' THEN nullif(reason, '') END AS reason,
      CASE WHEN event_type = 'PreCompact' THEN nullif(compact_trigger, '') END AS compact_trigger,
      CASE WHEN event_type = 'TaskCompleted' THEN nullif(task_id, '') END AS task_id),
    CAST(CASE WHEN event_type = 'UserPromptSubmit' AND starts_with(prompt_text, '/') THEN 1 ELSE 0 END AS BIGINT) AS is_slash_command,
    nullif(regexp_replace(list_last(string_split({_PATH}, '/')), '(.)\\.[^.]*$', '\\1'), '') AS skill_name,
    CASE WHEN lower({_PATH}) LIKE '%agents%' THEN 'agent' WHEN lower({_PATH}) LIKE '%project%' THEN 'project' WHEN lower({_PATH}) LIKE '%system%' THEN 'system' END AS skill_type,
    coalesce(strlen(tool_input), 0) AS input_bytes, coalesce(strlen(tool_result), 0) AS output_bytes,
    substr(sha256(concat(coalesce(session_id, ''), '|', coalesce(event_type, ''), '|', coalesce(timestamp, ''), '|', coalesce(tool_use_id, ''))), 1, 16) AS event_hash
  FROM tev),
pre AS (SELECT source_file, session_id, tool_use_id, arg_max(timestamp, (timestamp, raw_index)) AS pre_ts FROM tev WHERE event_type = 'PreToolUse' AND tool_use_id <> '' GROUP BY ALL),
ev AS MATERIALIZED (
  SELECT proj.*, CASE WHEN event_type IN ('PostToolUse', 'PostToolUseFailure') THEN {ms("pre_ts", "timestamp")} END AS duration_ms,
    CAST(row_number() OVER w - 1 AS BIGINT) AS sequence_num,
    CAST(sum(input_bytes + output_bytes + coalesce(prompt_length, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS context_cumulative_bytes
  FROM proj LEFT JOIN pre USING (source_file, session_id, tool_use_id)
  WINDOW w AS (PARTITION BY source_file, session_id ORDER BY timestamp, raw_index)),
srow AS (
  SELECT source_file, session_id,
    first(timestamp ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS started_at,
    last(timestamp ORDER BY timestamp, raw_index) FILTER (event_type = 'SessionEnd') AS ended_at,
    first(source ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS source,
    last(reason ORDER BY timestamp, raw_index) FILTER (event_type = 'SessionEnd') AS end_reason,
    first(model ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS model,
    first(cwd ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS cwd,
    first(config_version ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS config_version,
    first(git_branch ORDER BY event_type <> 'SessionStart', timestamp, raw_index) AS git_branch,
    last(context_cumulative_bytes ORDER BY timestamp, raw_index) FILTER (event_type = 'PreCompact' AND compact_trigger = 'auto') AS context_at_compact
  FROM ev GROUP BY source_file, session_id),
sfold AS (
  SELECT session_id, first(started_at ORDER BY source_file) AS started_at,
    {", ".join(f"last({c} ORDER BY source_file) FILTER ({c} IS NOT NULL) AS {c}" for c in ("ended_at", "source", "end_reason", "model", "cwd", "config_version", "git_branch", "context_at_compact"))}
  FROM srow GROUP BY session_id),
ctr AS (
  SELECT session_id, count(*) AS total_events, count(*) FILTER (event_type = 'PreToolUse') AS total_tool_calls, count(*) FILTER (event_type = 'PostToolUseFailure') AS total_failures,
    count(*) FILTER (event_type = 'UserPromptSubmit') AS total_prompts, count(*) FILTER (event_type = 'SubagentStart') AS total_subagents, count(*) FILTER (event_type = 'TaskCompleted') AS total_tasks,
    count(*) FILTER (event_type = 'SessionStart' AND source = 'compact') AS compaction_count, count(*) FILTER (event_type = 'PreCompact' AND compact_trigger = 'auto') AS auto_compact_count,
    count(*) FILTER (event_type = 'PermissionRequest') AS permission_prompts, max(coalesce(context_cumulative_bytes, 0)) AS context_total_bytes
  FROM ev GROUP BY session_id),
base AS MATERIALIZED (SELECT * FROM sfold JOIN ctr USING (session_id)),
cand AS (
  SELECT c.session_id, p.session_id AS parent_session_id, p.ended_at AS pend,
    (epoch_us(CAST(c.started_at AS TIMESTAMP)) - epoch_us(CAST(p.ended_at AS TIMESTAMP))) // 1000000 AS gap,
    CASE WHEN p.cwd = c.cwd AND p.cwd <> '' THEN 3 ELSE 0 END + CASE WHEN p.git_branch = c.git_branch AND p.git_branch <> '' THEN 2 ELSE 0 END
      + CASE WHEN p.model = c.model AND p.model <> '' THEN 1 ELSE 0 END + CASE WHEN p.end_reason = 'logout' THEN 0 ELSE 2 END AS rest
  FROM base c JOIN base p ON p.ended_at <= c.started_at AND p.session_id <> c.session_id
  WHERE c.source IN ('startup', 'resume') AND p.source IN ('startup', 'resume')),
scored AS (
  SELECT *, rest + CASE WHEN gap < 30 THEN 5 WHEN gap < 120 THEN 4 WHEN gap < 300 THEN 3 WHEN gap < 900 THEN 2 WHEN gap < 1800 THEN 1 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY session_id, gap > 1800 ORDER BY pend DESC, parent_session_id DESC) AS nth
  FROM cand),
edge AS MATERIALIZED (
  SELECT session_id, parent_session_id, CAST(score AS BIGINT) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, pend DESC, parent_session_id DESC) AS r FROM scored WHERE gap <= 1800 OR nth = 1)
  WHERE r = 1 AND score >= 6),
walk(session_id, up) AS (
  SELECT session_id, parent_session_id FROM edge UNION ALL SELECT walk.session_id, edge.parent_session_id FROM walk JOIN edge ON edge.session_id = walk.up),
chained AS (SELECT session_id, up AS chain_id FROM walk WHERE up NOT IN (SELECT session_id FROM edge)),
sessions AS MATERIALIZED (SELECT base.*, parent_session_id, chain_id FROM base LEFT JOIN edge USING (session_id) LEFT JOIN chained USING (session_id)),
paired AS (
  SELECT *, last_value(CASE WHEN event_type = 'PreToolUse' THEN {{'ts': timestamp, 'ti': tool_input, 'tn': tool_name, 'ai': agent_id, 'ty': agent_type, 'sn': skill_name, 'st': skill_type}} END IGNORE NULLS)
    OVER (PARTITION BY source_file, session_id, tool_use_id ORDER BY timestamp, raw_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM ev WHERE tool_use_id IS NOT NULL AND event_type IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure')),
trow AS MATERIALIZED (
  SELECT source_file, session_id, raw_index, tool_use_id, coalesce(tool_name, p.tn, '') AS tool_name, coalesce(agent_id, p.ai) AS agent_id, coalesce(agent_type, p.ty) AS agent_type,
    coalesce(p.ts, timestamp) AS started_at, timestamp AS completed_at, duration_ms, substr(p.ti, 1, 200) AS input_summary, output_bytes,
    CASE WHEN event_type = 'PostToolUseFailure' THEN error END AS error, CAST(CASE WHEN event_type = 'PostToolUseFailure' THEN 0 ELSE 1 END AS BIGINT) AS succeeded,
    coalesce(skill_name, p.sn) AS skill_name, coalesce(skill_type, p.st) AS skill_type
  FROM paired WHERE event_type <> 'PreToolUse'),
tnum AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_use_id ORDER BY source_file, completed_at, raw_index) AS nth FROM trow),
tool_calls AS MATERIALIZED (
  SELECT session_id, tool_use_id, {", ".join(f"first({c} ORDER BY nth) AS {c}" for c in ("tool_name", "agent_id", "agent_type", "started_at", "input_summary"))},
    {", ".join(f"last({c} ORDER BY nth) FILTER ({c} IS NOT NULL) AS {c}" for c in ("completed_at", "duration_ms", "output_bytes", "error", "skill_name", "skill_type"))},
    CASE WHEN count(*) FILTER (nth > 1 AND error IS NOT NULL) > 0 THEN 0 ELSE first(succeeded ORDER BY nth) END AS succeeded
  FROM tnum GROUP BY session_id, tool_use_id),
config_versions AS (SELECT * FROM (VALUES ('cfg0', '2024-01-01', 'first'), ('cfg1', '2024-01-02', NULL)) t(version_hash, captured_at, description)),
annotations AS (SELECT session_id, 'odd' AS label FROM sessions WHERE total_events % 2 = 1)
"""


def chain(body: str) -> str:
    return CHAIN + body


def _since(column: str, days: int) -> str:
    return f"CAST(CAST({column} AS TIMESTAMP) AS DATE) >= DATE '{NOW}' - {days}"


_DAY = "strftime(CAST(started_at AS TIMESTAMP), '%Y-%m-%d')"
_FAIL = "round(100.0 * count(*) FILTER (succeeded = 0) / count(*), 1)"
_TOOLS = f"SELECT tool_name, count(*) AS count, coalesce(avg(duration_ms), 0) AS avg_duration_ms, {_FAIL} AS failure_rate, CAST(sum(output_bytes) AS BIGINT) AS total_bytes FROM tool_calls"
_TIMELINE = "SELECT sequence_num, timestamp, event_type, tool_name, duration_ms, agent_type, skill_name, error, session_id FROM ev"
_FIRST = "(SELECT session_id FROM sessions WHERE lower(session_id) LIKE '{p}%' ORDER BY session_id LIMIT 1)"
_NEWEST = "(SELECT config_version FROM sessions WHERE config_version IS NOT NULL ORDER BY started_at DESC, session_id LIMIT 1)"
_COLUMNS = "raw_index, session_id, event_type"
_DUR = "CASE WHEN {x} IS NULL THEN '' WHEN {x} < 1000 THEN {x} || 'ms' WHEN {x} < 60000 THEN printf('%.1fs', {x} / 1000.0) ELSE ({x} // 60000) || 'm' || (({x} % 60000) // 1000) || 's' END"
_PARENT = "CASE WHEN regexp_matches({p}, '^/[^/]+$') THEN '/' WHEN contains({p}, '/') THEN nullif(regexp_replace({p}, '/[^/]*$', ''), '') END"
_TOUCHED = """touched AS (
  SELECT session_id, file_path, bool_or(agent_type IN ('search', 'ast-search', 'lsp-search') AND tool_name IN ('Read', 'NotebookRead')) AS explored,
    bool_or(agent_type = 'worker' AND tool_name IN ('Read', 'NotebookRead')) AS read, bool_or(agent_type = 'worker' AND tool_name IN ('Edit', 'Write', 'MultiEdit')) AS edited
  FROM ev WHERE event_type = 'PreToolUse' AND agent_type IS NOT NULL AND tool_name IS NOT NULL GROUP BY ALL),
prov AS (
  SELECT session_id, count(*) FILTER (explored) AS explorer_read_count, count(*) FILTER (read) AS worker_read_count,
    CASE WHEN count(*) FILTER (explored) > 0 AND count(*) FILTER (read) > 0 THEN count(*) FILTER (explored AND read) / count(*) FILTER (read) END AS reexploration_overlap,
    count(*) FILTER (edited) AS worker_edit_count, count(*) FILTER (edited AND NOT explored) AS coverage_edge_incidents
  FROM touched GROUP BY session_id)"""


def _trend(value: str) -> str:
    return f"SELECT {_DAY} AS date, CAST({value} AS DOUBLE) AS value FROM sessions WHERE {_since('started_at', 14)} GROUP BY 1 ORDER BY 1"


_STATS = f"""st AS (
  SELECT session_id, first(timestamp ORDER BY source_file, sequence_num) AS t0, first(cwd ORDER BY source_file, sequence_num) AS cwd, first(git_branch ORDER BY source_file, sequence_num) AS br,
    coalesce(last(timestamp ORDER BY source_file, sequence_num) FILTER (event_type = 'SessionEnd'), last(timestamp ORDER BY source_file, sequence_num)) AS t1,
    {", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS VARCHAR) AS {n}" for t, n in (("PreToolUse", "tc"), ("PostToolUseFailure", "fl"), ("UserPromptSubmit", "pr"), ("SubagentStart", "sa")))}
  FROM ev GROUP BY session_id),
tt AS (SELECT session_id, string_agg(tool_name || ':' || n, ', ' ORDER BY r) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool_name) AS r FROM (SELECT session_id, tool_name, count(*) AS n FROM ev WHERE tool_name <> '' GROUP BY ALL)) WHERE r <= 5 GROUP BY session_id),
figs AS (SELECT st.session_id AS id, [substr(st.session_id, 1, 8), replace(substr(t0, 1, 19), 'T', ' '), {_DUR.format(x=ms("t0", "t1"))}, tc, fl, pr, sa, coalesce(top, ''), coalesce(cwd, ''), coalesce(br, '')] AS v FROM st LEFT JOIN tt USING (session_id))"""

GATE = f""", pt AS (SELECT *, row_number() OVER (ORDER BY timestamp, raw_index) AS o FROM ev WHERE event_type = 'PreToolUse'),
seen AS (SELECT session_id, file_path, o FROM pt WHERE agent_type IN ('search', 'ast-search', 'lsp-search') AND tool_name IN ('Read', 'NotebookRead', 'Glob', 'Grep')),
judged AS (
  SELECT w.session_id, w.file_path, w.timestamp, w.raw_index,
    EXISTS (SELECT 1 FROM seen s WHERE s.session_id = w.session_id AND s.o < w.o)
    AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = w.session_id AND s.o < w.o AND (s.file_path = w.file_path OR {_PARENT.format(p="s.file_path")} = '/' OR starts_with(w.file_path || '/', {_PARENT.format(p="s.file_path")} || '/'))) AS open
  FROM pt w WHERE agent_type = 'worker')
SELECT session_id, file_path, timestamp, raw_index, CASE WHEN open AND row_number() OVER (PARTITION BY session_id, file_path ORDER BY open DESC, timestamp, raw_index) = 1 THEN 'warn' ELSE 'allow' END AS decision FROM judged"""

_WORDS = """, docs AS (SELECT doc_id AS id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+') AS w FROM documents),
idx AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs)
"""
_CHANGED = """, chg AS (SELECT * REPLACE (CASE WHEN raw_index % 97 = 0 THEN 'Other' ELSE tool_name END AS tool_name) FROM tev WHERE raw_index % 101 <> 0),
evdiff AS (
  SELECT CAST(raw_index AS VARCHAR) AS key, 'only_a' AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM tev WHERE raw_index % 101 = 0
  UNION ALL SELECT CAST(x.raw_index AS VARCHAR), 'differs', 'tool_name', x.tool_name, y.tool_name FROM tev x JOIN chg y USING (raw_index) WHERE x.tool_name IS DISTINCT FROM y.tool_name)
"""

_BODIES = {
    # log lines
    "scan_jsonl": f"SELECT raw_line FROM (SELECT {duck_text(RAW_LINE)} AS raw_line FROM tev) WHERE trim(raw_line) <> ''",
    "parse_envelope": "SELECT raw_index, timestamp AS ts FROM tev WHERE k % 50 > 2",
    "malformed_lines": "SELECT raw_index, CASE k % 50 WHEN 0 THEN 'JSON parse error' WHEN 1 THEN 'payload is not a JSON object' ELSE 'missing hook_event_name or session_id' END AS error FROM tev WHERE k % 50 < 3",
    "events_row": "SELECT raw_index, session_id, event_type, tool_name, file_path, prompt_text, prompt_length FROM tev WHERE k % 50 > 2",
    "tool_payload_text": "SELECT raw_index, '{\"file_path\":\"' || file_path || '\",\"k\":' || k || '}' AS tool_input, tool_result FROM tev WHERE k % 50 > 2",
    "replay": "SELECT raw_index + 1 AS line, CASE WHEN k % 50 = 0 THEN '' WHEN k % 50 < 3 THEN 'x' ELSE substr(timestamp, 1, 19) END AS ts, CASE WHEN k % 50 < 3 THEN '' ELSE substr(session_id, 1, 8) END AS session_id, CASE WHEN k % 50 = 0 THEN 'MALFORMED' WHEN k % 50 < 3 THEN '' ELSE event_type END AS event_type FROM tev",
    "tail_projection": "SELECT raw_index, CASE WHEN k % 50 = 0 THEN '[malformed] {broken' ELSE concat_ws('  ', substr(timestamp, 1, 19), substr(session_id, 1, 8), rpad(event_type, 25, ' '), tool_name) END AS shown FROM tev WHERE k % 50 = 0 OR (k % 50 > 2 AND tool_name = 'Bash')",
    "legacy_normalize": f"""SELECT raw_index, CASE k % 7 WHEN 0 THEN concat('{{"v":1,"ts":"', timestamp, '","p":{{"hook_event_name":"PreToolUse","session_id":"', session_id, '","tool_name":"Read","tool_use_id":"t', k, '","tool_input":{{"_legacy_summary":"é ', k, '"}},"cwd":"/p"}}}}')
  WHEN 1 THEN concat('{{"v":1,"ts":"', timestamp, '","p":{{"hook_event_name":"PostToolUse","session_id":"', session_id, '","tool_name":"Edit","tool_use_id":"legacy_x","tool_response":"","cwd":""}}}}')
  WHEN 2 THEN concat('{{"v":1,"ts":"{NOW}","p":{{"hook_event_name":"Odd","event_type":"Odd","session_id":"', session_id, '","n":', k, '}}}}')
  WHEN 3 THEN {duck_text(LEGACY_LINE)}
  ELSE concat('{{"v":1,"ts":"{NOW}","p":{{"hook_event_name":"UnknownEvent","session_id":"', session_id, '"}}}}') END AS raw_line FROM tev WHERE k % 7 IN (0, 1, 2, 3, 6)""",
    "ingest_stats": """SELECT count(*) FILTER (k % 50 > 2) AS events_seen, count(DISTINCT event_hash) FILTER (k % 50 > 2) AS events_stored, count(*) FILTER (k % 50 > 2) - count(DISTINCT event_hash) FILTER (k % 50 > 2) AS duplicates,
  count(*) FILTER (k % 50 < 3) AS malformed, count(DISTINCT session_id) FILTER (k % 50 > 2) AS sessions FROM ev""",
    "json_compact": f"SELECT raw_index, {picked([s[1] for s in JSON_SHAPES])} AS j FROM tev",
    "json_canonical": f"SELECT raw_index, {picked([s[2] for s in JSON_SHAPES])} AS j FROM tev",
    "json_equal": f"SELECT raw_index, {picked([p[2] for p in JSON_PAIRS])} AS same FROM tev",
    "annotate": f"SELECT session_id, 'odd' AS label, CAST(NULL AS VARCHAR) AS notes, '{NOW}' AS created_at FROM sessions WHERE session_id LIKE 'u9%' ORDER BY session_id LIMIT 1",
    # search, diffs, policy
    "search_boolean": _WORDS + "SELECT id FROM docs WHERE ((list_contains(w, 'the') AND list_contains(w, 'licensed')) OR list_contains(w, 'token')) AND NOT list_contains(w, 'released')",
    "search_phrase": _WORDS + "SELECT DISTINCT a.id FROM idx a JOIN idx b ON a.id = b.id AND b.pos = a.pos + 1 JOIN idx c ON a.id = c.id AND c.pos = a.pos + 2 WHERE a.term = 'licensed' AND b.term = 'under' AND c.term = 'the'",
    "search_near": _WORDS + "SELECT DISTINCT a.id FROM idx a JOIN idx b ON a.id = b.id AND abs(a.pos - b.pos) <= 3 WHERE a.term = 'license' AND b.term = 'version'",
    "search_prefix": _WORDS + "SELECT DISTINCT id FROM idx WHERE starts_with(term, 'licen')",
    "search": _WORDS
    + """, n AS (SELECT id, len(w) AS n FROM docs WHERE len(w) > 0), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
tf AS (SELECT id, term, count(*) AS tf FROM idx WHERE term IN ('license', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN n USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 50""",
    "parity_events": _CHANGED + "SELECT * FROM evdiff",
    "full_outer_diff": _CHANGED + "SELECT kind, field, count(*) AS n FROM evdiff GROUP BY ALL",
    "parity_tool_calls": "SELECT session_id || '|' || tool_use_id AS key, 'only_a' AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM tool_calls WHERE succeeded = 0 UNION ALL SELECT session_id || '|' || tool_use_id, 'differs', 'error', error, 'x' FROM tool_calls WHERE succeeded = 1 AND error IS DISTINCT FROM 'x'",
    "policy_audit": """, c AS (SELECT raw_index AS call_id, tool_name, k, CASE agent_type WHEN 'search' THEN 'reader' WHEN 'worker' THEN 'editor' WHEN 'reviewer' THEN NULL ELSE 'main' END AS profile FROM tev WHERE event_type = 'PreToolUse')
SELECT call_id, profile, CASE WHEN profile IS NULL THEN 'unknown agent'
  WHEN profile = 'reader' AND NOT (tool_name = 'Read' OR starts_with(tool_name, 'G')) OR profile = 'main' AND tool_name <> 'Bash' THEN 'tool not allowed'
  WHEN tool_name = 'Bash' AND k % 3 = 2 THEN 'wrapper command'
  WHEN tool_name = 'Bash' AND (profile = 'editor' AND k % 3 <> 0 OR profile = 'main' AND k % 3 <> 1) THEN 'command not allowed' END AS denied FROM c""",
    "policy_guards": """SELECT raw_index AS call_id, CASE agent_type WHEN 'worker' THEN 'worker' ELSE 'reviewer' END AS profile, CASE k % 5
  WHEN 0 THEN CASE WHEN git_branch = 'b1' THEN 'protected' END
  WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 'header' WHEN CAST(k AS VARCHAR)[1] NOT IN ('1', '2') THEN 'url' END
  WHEN 3 THEN CASE WHEN k % 3 > 0 AND agent_type <> 'worker' THEN 'unbounded' END
  WHEN 4 THEN CASE WHEN agent_type = 'worker' THEN 'composed command' END END AS denied FROM tev WHERE agent_type IS NOT NULL""",
    # enrichment
    "payload_extract": """SELECT raw_index, session_id, CASE WHEN k % 5 = 0 THEN k END AS prompt_length, CAST(k % 6 IN (0, 2) AS BIGINT) AS is_interrupt, CASE WHEN k % 3 = 0 THEN 'Größe ☃' END AS tool_name,
  CASE k % 4 WHEN 0 THEN '{"b":[1.5,1000.0,true],"\\u00e9":null}' WHEN 1 THEN 'plain é' WHEN 3 THEN '[]' END AS tool_input, CAST(CASE k % 4 WHEN 0 THEN 37 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 2 END AS BIGINT) AS input_bytes FROM tev""",
    "truthy_flags": "SELECT raw_index, CAST(k <> 0 AS BIGINT) AS flag FROM tev",
    "field_isolation": "SELECT raw_index, source, reason, compact_trigger, task_id FROM ev",
    "slash_flag": "SELECT raw_index, is_slash_command FROM ev",
    "skill_detect": "SELECT raw_index, skill_name, skill_type FROM ev",
    "byte_len": "SELECT raw_index, input_bytes, output_bytes FROM ev",
    "event_hash": "SELECT raw_index, event_hash FROM ev",
    "sequence_num": f"SELECT {_COLUMNS}, sequence_num FROM ev",
    "tool_duration": f"SELECT {_COLUMNS}, duration_ms FROM ev",
    "context_cumulative": f"SELECT {_COLUMNS}, input_bytes, output_bytes, context_cumulative_bytes FROM ev",
    "event_dedup": """SELECT raw_index, event_hash FROM (SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY timestamp, raw_index, source_file) AS r
  FROM (SELECT source_file, raw_index, timestamp, event_hash FROM ev UNION ALL SELECT source_file, raw_index + 1000000000, timestamp, event_hash FROM ev WHERE k % 3 = 0)) WHERE r = 1""",
    "session_rows": "SELECT * FROM srow",
    "session_upsert": "SELECT * FROM sfold",
    "session_counters": "SELECT * FROM ctr",
    "tool_call_pairing": "SELECT * FROM trow",
    "tool_call_upsert": "SELECT * FROM tool_calls",
    "lineage_score": "SELECT session_id, parent_session_id, score FROM edge",
    "lineage_parent": "SELECT session_id, parent_session_id FROM sessions WHERE parent_session_id IS NOT NULL",
    "lineage_chain": "SELECT session_id, chain_id FROM sessions",
    "lineage_candidates": "SELECT session_id, ended_at, cwd, git_branch, model, end_reason, source FROM sessions WHERE CAST(ended_at AS TIMESTAMP) > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE ORDER BY ended_at, session_id LIMIT 20",
    "git_join": """SELECT raw_index, cwd, CASE WHEN CAST(substr(source_file, -7, 1) AS INT) % 3 > 0 AND cwd = '/proj/0' THEN 'main' WHEN CAST(substr(source_file, -7, 1) AS INT) % 3 > 0 AND cwd = '/proj/1' THEN 'dev' ELSE git_branch END AS git_branch,
  CASE WHEN CAST(substr(source_file, -7, 1) AS INT) % 3 > 0 THEN CASE cwd WHEN '/proj/0' THEN 'abc' WHEN '/proj/1' THEN 'def' END END AS git_commit FROM ev""",
    "payload_merge": "SELECT raw_index, CASE WHEN CAST(substr(source_file, -7, 1) AS INT) % 2 = 0 THEN 'known' ELSE config_version END AS config_version FROM ev",
    # scalar functions
    "days_to_date": "SELECT DISTINCT k, strftime(DATE '1970-01-01' + CAST(k * 200 AS INTEGER), '%Y-%m-%d') AS day FROM tev",
    "parse_ts": "SELECT raw_index, epoch_us(CAST(timestamp AS TIMESTAMP)) AS micros, CAST(CAST(CAST(timestamp AS TIMESTAMP) AS DATE) AS VARCHAR) AS day FROM tev",
    "normalize_ts": "SELECT raw_index, replace(timestamp, 'Z', '+00:00') AS normalized FROM tev",
    "fmt_duration": f"SELECT raw_index, {_DUR.format(x='(k * k * k)')} AS shown FROM tev",
    "fmt_bytes": "SELECT raw_index, CASE WHEN k * k * k * 7 < 1024 THEN (k * k * k * 7) || 'B' WHEN k * k * k * 7 < 1048576 THEN printf('%.1fK', k * k * k * 7 / 1024.0) ELSE printf('%.1fM', k * k * k * 7 / 1048576.0) END AS shown FROM tev",
    "truncate": "SELECT raw_index, CASE WHEN length(file_path) > 8 THEN substr(file_path, 1, 8) || '…' ELSE file_path END AS shown FROM tev",
    "commas": "SELECT raw_index, format('{:,}', k * 12345) AS shown FROM tev",
    # commands
    "summary": f"SELECT {_DAY} AS date, count(DISTINCT session_id) AS sessions, CAST(sum(total_tool_calls) AS BIGINT) AS tool_calls, CAST(sum(total_failures) AS BIGINT) AS failures, CAST(sum(total_prompts) AS BIGINT) AS prompts, CAST(sum(total_subagents) AS BIGINT) AS subagents, count(DISTINCT config_version) AS config_versions FROM sessions WHERE {_since('started_at', 7)} GROUP BY 1",
    "sessions": f"SELECT session_id, started_at, {ms('started_at', 'ended_at')} AS duration_ms, total_tool_calls AS tool_calls, total_failures AS failures, cwd, git_branch AS branch, chain_id, source FROM sessions WHERE {_since('started_at', 30)} AND lower(cwd) LIKE '%proj%' AND git_branch = 'b1' AND session_id IN (SELECT session_id FROM annotations WHERE label = 'odd') ORDER BY started_at DESC, session_id LIMIT 100",
    "session_timeline": f"{_TIMELINE} WHERE session_id = {_FIRST.format(p='u8')}",
    "session_events": f"SELECT * FROM ev WHERE session_id = {_FIRST.format(p='u8')}",
    "last": f"{_TIMELINE} WHERE session_id = (SELECT session_id FROM sessions ORDER BY started_at DESC, session_id LIMIT 1)",
    "chain": "SELECT session_id, started_at, ended_at, total_tool_calls AS tool_calls, total_failures AS failures, total_prompts AS prompts, git_branch AS branch, cwd, chain_id FROM sessions WHERE chain_id = (SELECT chain_id FROM sessions WHERE session_id = (SELECT session_id FROM sessions WHERE session_id LIKE 'u1%' ORDER BY session_id LIMIT 1))",
    "tools": f"{_TOOLS} GROUP BY tool_name",
    "tools_current": f"{_TOOLS} WHERE session_id IN (SELECT session_id FROM sessions WHERE config_version = {_NEWEST}) GROUP BY tool_name",
    "agents": f"SELECT agent_type, count(DISTINCT agent_id) AS instance_count, avg(n) AS avg_tool_calls, {_FAIL} AS failure_rate, avg(duration_ms) AS avg_duration_ms FROM tool_calls LEFT JOIN (SELECT agent_id, count(*) AS n FROM tool_calls WHERE agent_id IS NOT NULL GROUP BY agent_id) USING (agent_id) WHERE agent_type IS NOT NULL GROUP BY agent_type",
    "skills": "SELECT skill_name, skill_type, count(*) AS usage_count, count(DISTINCT session_id) AS sessions_count, count(DISTINCT agent_type) AS agent_types FROM ev WHERE skill_name IS NOT NULL GROUP BY ALL",
    "failures": f"SELECT timestamp, session_id, tool_name, agent_type, duration_ms, error FROM ev WHERE event_type = 'PostToolUseFailure' AND {_since('timestamp', 7)} ORDER BY timestamp DESC, raw_index DESC LIMIT 200",
    "before_stop": "SELECT session_id, timestamp, m5, m4, m3, m2, m1 FROM (SELECT session_id, timestamp, raw_index, event_type, "
    + ", ".join(f"lag(event_type || '/' || coalesce(tool_name, ''), {k}) OVER w AS m{k}" for k in range(5, 0, -1))
    + " FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY source_file, sequence_num)) WHERE event_type = 'Stop' ORDER BY timestamp DESC, raw_index DESC LIMIT 50",
    "compactions": "SELECT session_id, timestamp, compact_trigger, sequence_num, git_branch, context_cumulative_bytes FROM ev WHERE event_type = 'PreCompact' ORDER BY timestamp DESC, raw_index DESC LIMIT 100",
    "configs": "SELECT config_version, description AS label, count(DISTINCT session_id) AS sessions, avg(total_tool_calls) AS avg_tool_calls, avg(total_failures) AS avg_failures, min(started_at) AS first_seen, max(started_at) AS last_seen FROM sessions LEFT JOIN config_versions ON version_hash = config_version WHERE config_version IS NOT NULL GROUP BY ALL",
    "table_counts": "SELECT 'events_count' AS key, count(*) AS value FROM ev UNION ALL SELECT 'sessions_count', count(*) FROM sessions UNION ALL SELECT 'tool_calls_count', count(*) FROM tool_calls",
    "chain_stats": "SELECT count(*) AS chains, coalesce(avg(n), 0) AS avg_chain_size FROM (SELECT chain_id, count(*) AS n FROM sessions WHERE chain_id IS NOT NULL GROUP BY chain_id)",
    "trends_sessions": _trend("count(DISTINCT session_id)"),
    "trends_tool_calls": _trend("sum(total_tool_calls)"),
    "trends_failures": _trend("sum(total_failures)"),
    "trends_prompts": _trend("sum(total_prompts)"),
    "trends_duration": _trend(f"avg({ms('started_at', 'ended_at')})"),
    "sparkline": f"SELECT string_agg(substr(' ▁▂▃▄▅▆▇█', CAST(least(9, floor(value / (CASE WHEN top = 0 THEN 1 ELSE top END) * 8) + 1) AS BIGINT), 1), '' ORDER BY date) AS sparkline FROM (SELECT *, max(value) OVER () AS top FROM ({_trend('sum(total_tool_calls)')}))",
    "slow": "SELECT session_id, tool_name, agent_type, duration_ms, started_at, error, input_summary FROM tool_calls WHERE duration_ms > 5000 ORDER BY duration_ms DESC, session_id, tool_use_id LIMIT 50",
    "tokens": "SELECT session_id, context_total_bytes, context_total_bytes // 4 AS est_tokens, started_at FROM sessions WHERE context_total_bytes > 0 ORDER BY context_total_bytes DESC, session_id LIMIT 20",
    "export": "SELECT CAST(to_json({"
    + ", ".join(f"'{c}': {c}" for c in ("session_id", "started_at", "ended_at", "total_tool_calls", "total_failures", "total_prompts", "total_subagents", "cwd", "git_branch", "chain_id", "config_version", "source", "model", "context_total_bytes"))
    + "}) AS VARCHAR) AS value FROM sessions WHERE CAST(CAST(started_at AS TIMESTAMP) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "daily_totals": "SELECT count(*) AS sessions, "
    + ", ".join(f"CAST(coalesce(sum(total_{c}), 0) AS BIGINT) AS {c}" for c in ("tool_calls", "failures", "prompts", "subagents"))
    + " FROM sessions WHERE CAST(CAST(started_at AS TIMESTAMP) AS DATE) = DATE '2024-01-08'",
    "label_upsert": f"SELECT coalesce(version_hash, newest) AS version_hash, coalesce(captured_at, '{NOW}') AS captured_at, CASE WHEN newest IS NOT NULL THEN 'stable' ELSE description END AS description FROM config_versions FULL JOIN (SELECT {_NEWEST} AS newest) ON version_hash = newest",
    "prune_counts": " UNION ALL ".join(f"SELECT '{k}_count' AS key, count(*) AS value FROM {t} WHERE CAST(CAST({c} AS TIMESTAMP) AS DATE) < DATE '2024-01-15'" for k, t, c in (("events", "ev", "timestamp"), ("sessions", "sessions", "started_at"), ("tool_calls", "tool_calls", "started_at"))),
    "sql_passthrough": "SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS s FROM ev GROUP BY event_type HAVING count(*) > 10",
    # live
    "coverage": f""", own AS (SELECT * FROM ev WHERE agent_id = 'a3'), rd AS (SELECT DISTINCT file_path FROM own WHERE tool_name IN ('Read', 'NotebookRead') AND file_path IS NOT NULL)
SELECT 'read' AS kind, file_path AS item FROM rd UNION ALL SELECT DISTINCT 'dir', {_PARENT.format(p="file_path")} FROM rd WHERE {_PARENT.format(p="file_path")} IS NOT NULL
UNION ALL SELECT kind, '<redacted:' || unnest(range(1, n + 1)) || '>' FROM (SELECT lower(tool_name) AS kind, count(DISTINCT tool_input) AS n FROM own WHERE tool_name IN ('Glob', 'Grep') GROUP BY 1)""",
    "provenance_sessions": f", {_TOUCHED} SELECT * FROM prov",
    "provenance_marked": f", {_TOUCHED.replace('FROM ev', 'FROM (SELECT * FROM ev WHERE k % 13 > 1)')} SELECT * FROM prov",
    "provenance_total": f", {_TOUCHED} SELECT count(reexploration_overlap) AS sessions_with_both, round(avg(reexploration_overlap), 4) AS mean_reexploration_overlap, CAST(coalesce(sum(worker_edit_count), 0) AS BIGINT) AS total_worker_edits, CAST(coalesce(sum(coverage_edge_incidents), 0) AS BIGINT) AS total_coverage_edge_incidents FROM prov",
    "gate_decisions": GATE,
    "session_diff": f""", {_STATS}, m AS (SELECT unnest(range(10)) AS ord, unnest(['session_id', 'started_at', 'duration', 'tool_calls', 'failures', 'prompts', 'subagents', 'top_tools', 'cwd', 'branch']) AS metric)
SELECT CAST(ord AS INTEGER) AS ord, metric, (SELECT v[ord + 1] FROM figs WHERE id = {_FIRST.format(p="u1")}) AS a, (SELECT v[ord + 1] FROM figs WHERE id = {_FIRST.format(p="u2")}) AS b FROM m""",
    "top_tools": "SELECT session_id, tool_name, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tool_name) AS rank FROM (SELECT session_id, tool_name, count(*) AS n FROM ev WHERE tool_name <> '' GROUP BY ALL)) WHERE rank <= 5",
    # relational shapes
    "join_inner_filter": "SELECT ev.raw_index, ev.session_id, sessions.total_events FROM ev JOIN sessions USING (session_id) WHERE sessions.config_version = 'cfg1'",
    "join_left_dim": "SELECT session_id, description FROM sessions LEFT JOIN config_versions ON version_hash = config_version",
    "join_self_agg": "SELECT session_id, tool_use_id, n FROM tool_calls LEFT JOIN (SELECT agent_id, count(*) AS n FROM tool_calls WHERE agent_id IS NOT NULL GROUP BY agent_id) USING (agent_id)",
    "semi_exists": "SELECT session_id FROM sessions s WHERE EXISTS (SELECT 1 FROM ev WHERE ev.session_id = s.session_id AND event_type = 'PostToolUseFailure')",
    "in_list": "SELECT raw_index FROM ev WHERE tool_name IN ('Read', 'Grep')",
    "paths_intersect": "SELECT DISTINCT session_id, file_path FROM ev WHERE agent_type = 'worker' INTERSECT SELECT session_id, file_path FROM ev WHERE agent_type = 'search'",
    "paths_except": "SELECT DISTINCT session_id, file_path FROM ev WHERE agent_type = 'worker' EXCEPT SELECT session_id, file_path FROM ev WHERE agent_type = 'search'",
    "path_prefix": f"SELECT DISTINCT w.session_id, w.file_path FROM ev w JOIN ev s ON w.session_id = s.session_id AND s.agent_type = 'search' AND starts_with(w.file_path || '/', {_PARENT.format(p='s.file_path')} || '/') WHERE w.agent_type = 'worker'",
    "like_prefix": "SELECT session_id FROM sessions WHERE session_id ILIKE 'U1%'",
    "like_substring": "SELECT raw_index FROM ev WHERE file_path ILIKE '%/F1%'",
    "agg_basic": "SELECT event_type, count(*) AS n, sum(output_bytes)::BIGINT AS total, avg(output_bytes) AS mean, min(output_bytes) AS low, max(output_bytes) AS high FROM ev GROUP BY event_type",
    "agg_distinct": "SELECT event_type, count(DISTINCT session_id) AS sessions, count(DISTINCT tool_name) AS tools FROM ev GROUP BY event_type",
    "agg_conditional": f"SELECT tool_name, {_FAIL} AS failure_rate FROM tool_calls GROUP BY tool_name",
    "agg_global": "SELECT count(*) AS n, coalesce(sum(output_bytes), 0)::BIGINT AS total FROM ev",
    "agg_nested": "SELECT avg(n) AS mean_size, max(n) AS max_size FROM (SELECT session_id, count(*) AS n FROM ev GROUP BY session_id)",
    "agg_by_date": "SELECT CAST(CAST(CAST(timestamp AS TIMESTAMP) AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM ev GROUP BY ALL",
    "window_lag": "SELECT raw_index, lag(event_type) OVER (PARTITION BY session_id ORDER BY source_file, sequence_num) AS prev FROM ev",
    "window_running_sum": "SELECT raw_index, CAST(sum(output_bytes) OVER (PARTITION BY session_id ORDER BY timestamp, raw_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ev",
    "window_row_number": "SELECT raw_index, CAST(row_number() OVER (PARTITION BY session_id ORDER BY timestamp, raw_index) AS INTEGER) AS n FROM ev",
    "window_asof_last": "SELECT raw_index, last_value(CASE WHEN event_type = 'PreToolUse' THEN timestamp END IGNORE NULLS) OVER (PARTITION BY session_id, tool_use_id ORDER BY timestamp, raw_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre FROM ev WHERE tool_use_id IS NOT NULL",
    "topk": "SELECT raw_index, output_bytes FROM ev ORDER BY output_bytes DESC, raw_index LIMIT 20",
    "union_files": "SELECT raw_index FROM ev WHERE timestamp < '2024-01-15' UNION ALL SELECT raw_index FROM ev WHERE timestamp >= '2024-01-15'",
    "daily_window": "SELECT CAST(CAST(CAST(timestamp AS TIMESTAMP) AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM ev GROUP BY ALL",
}

SQL = {k: chain(v) for k, v in _BODIES.items()}

# the sessions of all events against those of the events that _changed() leaves; only totals and times can differ
_SIDE = "SELECT session_id, started_at, ended_at, source, model, CAST(total_events AS VARCHAR) AS total_events FROM sessions"
_FEWER = chain(_SIDE).replace(f"({TEV})", f"(SELECT * FROM ({TEV}) WHERE raw_index % 101 <> 0)", 1)
_NORMAL = "CASE WHEN {x} LIKE '%Z' THEN left({x}, length({x}) - 1) || '+00:00' ELSE {x} END"
_SEEN = {c: (_NORMAL.format(x=f"a.{c}"), _NORMAL.format(x=f"b.{c}")) if c.endswith("_at") else (f"a.{c}", f"b.{c}") for c in ("started_at", "ended_at", "source", "model", "total_events")}
SQL["parity_sessions"] = f"""WITH a AS ({chain(_SIDE)}), b AS ({_FEWER})
SELECT coalesce(a.session_id, b.session_id) AS key, CASE WHEN b.session_id IS NULL THEN 'only_a' ELSE 'only_b' END AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM a FULL JOIN b USING (session_id) WHERE a.session_id IS NULL OR b.session_id IS NULL
""" + "".join(f"UNION ALL SELECT a.session_id, 'differs', '{c}', {x}, {y} FROM a JOIN b USING (session_id) WHERE {x} IS DISTINCT FROM {y}\n" for c, (x, y) in _SEEN.items())
SQL |= {"search_stored": SQL["search"], "search_stored_phrase": SQL["search_phrase"]}
