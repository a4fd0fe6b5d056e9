"""Every named query of the engine, with its DuckDB oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.functions import json_text
from sessionloom.operators import commands as C
from sessionloom.operators import diff as D
from sessionloom.operators import enrich as N
from sessionloom.operators import live as L
from sessionloom.operators import policy as P
from sessionloom.operators import search as S
from sessionloom.plans import oracles
from sessionloom.plans.adapter import JSON_PAIRS, JSON_SHAPES, LEGACY_LINE, NOW, PAYLOAD_LINE, RAW_LINE, picked, spark_text, telemetry
from sessionloom.runtime import scratch_dir
from sessionloom.sources import jsonl
from sessionloom.store import Store, known


class Tables:
    """The derived tables over one set of benchmark files, each made on demand
    and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.raw = telemetry(spark, sf_dir)

    @property
    def lines(self) -> DataFrame:
        """The events as lines of a log, some of them broken."""
        payload = F.struct(F.col("event_type").alias("hook_event_name"), "session_id", "tool_name", "tool_use_id", "agent_id", "agent_type", F.struct("file_path", "k").alias("tool_input"), F.col("tool_result").alias("tool_response"), "error", F.col("prompt_text").alias("prompt"), "prompt_length", "source", "cwd", "model")
        whole = F.to_json(F.struct(F.lit(1).alias("v"), F.col("timestamp").alias("ts"), payload.alias("p")))
        broken = F.when(F.col("k") % 50 == 0, "{broken").when(F.col("k") % 50 == 1, '{"v":1,"ts":"x","p":3}').when(F.col("k") % 50 == 2, '{"v":1,"ts":"x","p":{}}')
        return self.raw.select("source_file", "raw_index", F.coalesce(broken, whole).alias("raw_line"))

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/documents.parquet")

    @property
    def events(self) -> DataFrame:
        return N.enrich(self.raw)

    @property
    def projected(self) -> DataFrame:
        return E.with_projections(self.raw)

    @property
    def base(self) -> DataFrame:
        return N.sessions(self.events)

    @property
    def sessions(self) -> DataFrame:
        return N.with_lineage(self.base)

    @property
    def tool_rows(self) -> DataFrame:
        return N.tool_call_rows(self.events)

    @property
    def tool_calls(self) -> DataFrame:
        return N.fold_tool_calls(self.tool_rows)

    @property
    def config_versions(self) -> DataFrame:
        return self.spark.createDataFrame([("cfg0", "2024-01-01", "first"), ("cfg1", "2024-01-02", None)], "version_hash string, captured_at string, description string")

    @property
    def annotations(self) -> DataFrame:
        return self.base.where("total_events % 2 = 1").select("session_id", F.lit("odd").alias("label"))


def _path_prefix(t: Tables) -> DataFrame:
    dirs = t.raw.where("agent_type = 'search'").select("session_id", E.parent_dir(F.col("file_path")).alias("path")).distinct()
    paths = t.raw.where("agent_type = 'worker'").select("session_id", "file_path").distinct()
    return paths.withColumn("path", F.explode(E.ancestors(F.col("file_path")))).join(dirs, ["session_id", "path"], "left_semi").select("session_id", "file_path").distinct()


def _sql(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS s FROM {events} GROUP BY event_type HAVING count(*) > 10", events=t.raw)


def _coverage_input(t: Tables) -> DataFrame:
    return t.raw.withColumn("pattern", F.col("tool_input"))


def _changed(events: DataFrame) -> DataFrame:
    """Some rows gone, some values changed: the other side of a table diff."""
    kept = events.where("raw_index % 101 <> 0")
    return kept.withColumns({"tool_name": F.when(F.col("raw_index") % 97 == 0, "Other").otherwise(F.col("tool_name")), "timestamp": F.regexp_replace("timestamp", "Z$", "+00:00")})


def _events_diff(t: Tables) -> DataFrame:
    cols = ("raw_index", "session_id", "event_type", "tool_name", "timestamp", "tool_input")
    return D.table_diff(t.raw.select(*cols), _changed(t.raw).select(*cols), ["raw_index"], json=("tool_input",), times=("timestamp",))


def _sessions_diff(t: Tables) -> DataFrame:
    cols = ("session_id", "started_at", "ended_at", "source", "model", "total_events")
    changed = N.sessions(N.enrich(_changed(t.raw).withColumn("timestamp", F.regexp_replace("timestamp", r"\+00:00$", "Z"))))
    return D.sessions_diff(t.base.select(*cols), changed.select(*cols))


def _tool_calls_diff(t: Tables) -> DataFrame:
    cols = ("session_id", "tool_use_id", "tool_name", "succeeded", "error", "started_at")
    return D.tool_calls_diff(t.tool_calls.select(*cols), t.tool_calls.where("succeeded = 1").withColumn("error", F.lit("x")).select(*cols))


def _repeated(t: Tables) -> DataFrame:
    """The events, a third of them twice under another number."""
    own = t.projected.select("source_file", "raw_index", "timestamp", "event_hash", "k")
    return own.unionByName(own.where("k % 3 = 0").withColumn("raw_index", F.col("raw_index") + 1_000_000_000))


def _written_lines(t: Tables) -> DataFrame:
    """Lines of files, blank ones among them, as the scan reads them back."""
    folder = f"{scratch_dir(t.spark)}/logs"
    t.raw.selectExpr(f"{spark_text(RAW_LINE)} AS value").write.text(folder)
    return jsonl.scan(t.spark, [folder]).select("raw_line")


def _as_lines(t: Tables, template: str) -> DataFrame:
    return t.raw.selectExpr("source_file", "raw_index", f"{_doubled(spark_text(template))} AS raw_line")


def _doubled(sql: str) -> str:
    return sql.replace("\\", "\\\\")  # Spark reads a backslash in a literal as an escape


def _payload(t: Tables) -> DataFrame:
    return jsonl.events(jsonl.envelopes(_as_lines(t, PAYLOAD_LINE))).select("raw_index", "session_id", "prompt_length", "is_interrupt", "tool_name", "tool_input", "input_bytes")


def _known(t: Tables) -> DataFrame:
    """Events of files of which the configuration or the folders' branches are known."""
    day = F.substring("source_file", -7, 1).cast("int")
    git = F.when(day % 3 > 0, F.lit('{"/proj/0":["main","abc"],"/proj/1":["dev","def"]}'))
    lines = t.raw.select("source_file", F.when(day % 2 == 0, F.lit("known")).alias("config_version"), git.alias("git"))
    return known(t.raw.withColumn("git_commit", F.lit(None).cast("string")), lines)


def _annotated(t: Tables) -> DataFrame:
    store = Store(t.spark, f"{scratch_dir(t.spark)}/annotated")
    store.write(sessions=t.base)
    store.annotate("U9", "odd", None, NOW)
    return store.table("annotations")


def _ingested(t: Tables) -> DataFrame:
    store = Store(t.spark, f"{scratch_dir(t.spark)}/ingested")
    stats = store.ingest_lines(t.lines)
    return t.spark.createDataFrame([tuple(stats[k] for k in INGESTED)], ", ".join(f"{k} long" for k in INGESTED))


INGESTED = ("events_seen", "events_stored", "duplicates", "malformed", "sessions")


def _searched(t: Tables) -> DataFrame:
    return S.build(t.documents, "doc_id", ["text"])


def _written_index(t: Tables, asked: list[str]) -> tuple[DataFrame, DataFrame]:
    """An index written in two additions, opened for some words, and its size."""
    folder = f"{scratch_dir(t.spark)}/index"
    for half in (0, 1):
        S.write(t.documents.where(F.pmod("doc_id", F.lit(2)) == half), "doc_id", ["text"], folder)
    return S.read(t.spark, folder, asked, "long"), S.size_of(t.spark, folder)


def _stored_search(t: Tables) -> DataFrame:
    asked = ["license", "version"]
    index, size = _written_index(t, asked)
    return S.ranked(index, asked, size=size).select("id", F.round("score", 9).alias("score"))


def _boolean(t: Tables) -> DataFrame:
    i = _searched(t)
    return S.but_not(S.any_of(S.all_of(S.term(i, "the"), S.term(i, "licensed")), S.term(i, "token")), S.term(i, "released"))


def _policy(t: Tables) -> DataFrame:
    def make(rows: list[tuple], schema: str) -> DataFrame:
        return P.table(t.spark, rows, schema)

    rules = P.Rules(
        make([("search", "reader"), ("worker", "editor"), ("", "main")], "agent string, profile string"),
        make([("reader", "Read"), ("reader", "G*"), ("editor", "*"), ("main", "Bash")], "profile string, tool string"),
        make([("main", "search")], "profile string, target string"),
        make([("editor", "git status"), ("main", "ls")], "profile string, words string"),
    )
    command = F.when(F.col("tool_name") == "Bash", F.when(F.col("k") % 3 == 0, "git status -s").when(F.col("k") % 3 == 1, "/bin/ls -l").otherwise("sudo rm x"))
    calls = t.raw.where("event_type = 'PreToolUse'").select(F.col("raw_index").alias("call_id"), "agent_type", "tool_name", command.alias("command"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("bypass"))
    return P.audit(calls, rules)


_GUARDS = """
[profiles._default]
[profiles.worker]
tools = ["Bash"]
safety-overrides = ["bounded"]
commands = { categories = ["all"], structure = { single-command = true, no-redirection = true } }
[profiles.reviewer]
aliases = ["search"]
tools = ["Bash"]
commands = { categories = ["all"] }
[command-categories.all]
allow = [["git"], ["curl"], ["docker", "logs"]]
[safety]
bounded = { kind = "require-bounded-logs", command = { prefix = ["docker", "logs"] }, message = "unbounded" }
branch = { kind = "deny-protected-branch", command = { prefix = ["git", "push"] }, branches = ["b1"], message = "protected" }
header = { kind = "allow-curl-headers", command = { prefix = ["curl"] }, prefixes = ["Accept: "], message = "header" }
url = { kind = "require-curl-url-prefix", command = { prefix = ["curl"] }, prefixes = ["https://a.b/1", "https://a.b/2"], message = "url" }
"""


def _guarded(t: Tables) -> DataFrame:
    """Shell lines made of the events' own fields, under guards and limits of profiles."""
    branch, n = F.coalesce("git_branch", F.lit("b0")), F.col("k").cast("string")
    command = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("git -C "), "cwd", F.lit(" push origin HEAD:"), branch))
        .when(F.col("k") % 5 == 1, F.concat(F.lit("curl -s -H '"), F.when(F.col("k") % 2 == 0, "Accept: a|b").otherwise("X: y"), F.lit("' \"https://a.b/"), n, F.lit('"')))
        .when(F.col("k") % 5 == 2, F.concat(F.lit('git log --grep "'), "file_path", F.lit(' | ; > x"')))
        .when(F.col("k") % 5 == 3, F.concat(F.lit("docker logs "), F.when(F.col("k") % 3 == 0, "--tail=5 ").otherwise(""), "model"))
        .otherwise(F.concat(F.lit("git status > "), "file_path", F.lit(" && git log")))
    )
    calls = t.raw.where(F.col("agent_type").isNotNull()).select(F.col("raw_index").alias("call_id"), "agent_type", F.lit(P.SHELL).alias("tool_name"), command.alias("command"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("bypass"))
    return P.audit(calls, P.read_rules(t.spark, _GUARDS))


_IDS = ("raw_index", "session_id", "event_type")
_SINCE, _SPLIT = "2024-01-20 12:00:00", "2024-01-15"

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # enrichment
    "payload_extract": _payload,
    "truthy_flags": lambda t: t.raw.select("raw_index", E.truthy(F.to_json(F.struct("k")), "k").alias("flag")),
    "field_isolation": lambda t: t.projected.select("raw_index", "source", "reason", "compact_trigger", "task_id"),
    "slash_flag": lambda t: t.projected.select("raw_index", "is_slash_command"),
    "skill_detect": lambda t: t.projected.select("raw_index", "skill_name", "skill_type"),
    "byte_len": lambda t: t.projected.select("raw_index", "input_bytes", "output_bytes"),
    "event_hash": lambda t: t.projected.select("raw_index", "event_hash"),
    "sequence_num": lambda t: t.events.select(*_IDS, "sequence_num"),
    "tool_duration": lambda t: t.events.select(*_IDS, "duration_ms"),
    "context_cumulative": lambda t: t.events.select(*_IDS, "input_bytes", "output_bytes", "context_cumulative_bytes"),
    "event_dedup": lambda t: N.first_of_hash(_repeated(t)).select("raw_index", "event_hash"),
    "session_rows": lambda t: N.session_rows(t.events),
    "session_upsert": lambda t: N.fold_sessions(N.session_rows(t.events)),
    "session_counters": lambda t: N.counters(t.events),
    "tool_call_pairing": lambda t: t.tool_rows,
    "tool_call_upsert": lambda t: t.tool_calls,
    "lineage_score": lambda t: N.parents(t.base),
    "lineage_parent": lambda t: N.parents(t.base).select("session_id", "parent_session_id"),
    "lineage_chain": lambda t: t.sessions.select("session_id", "chain_id"),
    "lineage_candidates": lambda t: N.lineage_candidates(t.base, _SINCE),
    "git_join": lambda t: _known(t).select("raw_index", "cwd", "git_branch", "git_commit"),
    "payload_merge": lambda t: _known(t).select("raw_index", "config_version"),
    # log lines
    "scan_jsonl": _written_lines,
    "parse_envelope": lambda t: jsonl.envelopes(t.lines).select("raw_index", "ts"),
    "malformed_lines": lambda t: jsonl.malformed(t.lines).select("raw_index", "error"),
    "events_row": lambda t: jsonl.events(jsonl.envelopes(t.lines)).select("raw_index", "session_id", "event_type", "tool_name", "file_path", "prompt_text", "prompt_length"),
    "tool_payload_text": lambda t: jsonl.events(jsonl.envelopes(t.lines)).select("raw_index", "tool_input", "tool_result"),
    "replay": lambda t: jsonl.replay(t.lines).select("line", "ts", "session_id", "event_type"),
    "tail_projection": lambda t: jsonl.tail_lines(t.lines, "bash").select("raw_index", "shown"),
    # ids made from a hash of the line are shown without it
    "legacy_normalize": lambda t: jsonl.normalize_legacy(_as_lines(t, LEGACY_LINE), NOW).select("raw_index", F.regexp_replace("raw_line", "legacy_[0-9a-f]+", "legacy_x").alias("raw_line")),
    "ingest_stats": _ingested,
    "json_compact": lambda t: t.raw.select("raw_index", json_text.compact(F.expr(_doubled(picked([s[0] for s in JSON_SHAPES])))).alias("j")),
    "json_canonical": lambda t: t.raw.select("raw_index", json_text.canonical(F.expr(_doubled(picked([s[0] for s in JSON_SHAPES])))).alias("j")),
    "json_equal": lambda t: t.raw.select("raw_index", json_text.equal(*[F.expr(_doubled(picked([p[i] for p in JSON_PAIRS]))) for i in (0, 1)]).alias("same")),
    "annotate": _annotated,
    # search, diffs, policy
    "search_boolean": _boolean,
    "search_phrase": lambda t: S.phrase(_searched(t), ["licensed", "under", "the"]),
    "search_near": lambda t: S.near(_searched(t), "license", "version", 3),
    "search_prefix": lambda t: S.prefix(_searched(t), "licen"),
    "search": lambda t: S.ranked(_searched(t), ["license", "version"]).select("id", F.round("score", 9).alias("score")),
    "search_stored": _stored_search,
    "search_stored_phrase": lambda t: S.phrase(_written_index(t, ["licensed", "under", "the"])[0], ["licensed", "under", "the"]),
    "parity_events": _events_diff,
    "full_outer_diff": lambda t: D.report(_events_diff(t)),
    "parity_sessions": _sessions_diff,
    "parity_tool_calls": _tool_calls_diff,
    "policy_audit": _policy,
    "policy_guards": _guarded,
    # scalar functions
    "days_to_date": lambda t: t.raw.select("k", E.days_to_date(F.col("k") * 200).alias("day")).distinct(),
    "parse_ts": lambda t: t.raw.select("raw_index", F.unix_micros(E.parse_ts(F.col("timestamp"))).alias("micros"), E.event_date(F.col("timestamp")).cast("string").alias("day")),
    "normalize_ts": lambda t: t.raw.select("raw_index", E.normalize_ts(F.col("timestamp")).alias("normalized")),
    "fmt_duration": lambda t: t.raw.select("raw_index", E.fmt_duration(F.col("k") * F.col("k") * F.col("k")).alias("shown")),
    "fmt_bytes": lambda t: t.raw.select("raw_index", E.fmt_bytes(F.col("k") * F.col("k") * F.col("k") * 7).alias("shown")),
    "truncate": lambda t: t.raw.select("raw_index", E.truncate(F.col("file_path"), 8).alias("shown")),
    "commas": lambda t: t.raw.select("raw_index", E.commas(F.col("k") * 12345).alias("shown")),
    # commands
    "summary": lambda t: C.summary(t.base, NOW),
    "sessions": lambda t: C.session_list(t.sessions, NOW, cwd="PROJ", branch="b1", label="odd", annotations=t.annotations),
    "session_timeline": lambda t: C.session_timeline(t.events, t.base, "u8"),
    "session_events": lambda t: C.session_events(t.events, t.base, "u8").drop("config_source"),
    "last": lambda t: C.last_session(t.events, t.base),
    "chain": lambda t: C.chain(t.sessions, "u1"),
    "tools": lambda t: C.tools(t.tool_calls),
    "tools_current": lambda t: C.tools_current(t.tool_calls, t.base),
    "agents": lambda t: C.agents(t.tool_calls),
    "skills": lambda t: C.skills(t.projected),
    "failures": lambda t: C.failures(t.events, NOW),
    "before_stop": lambda t: C.before_stop(t.events),
    "compactions": lambda t: C.compactions(t.events),
    "configs": lambda t: C.configs(t.base, t.config_versions),
    "table_counts": lambda t: C.table_counts({"events": t.raw, "sessions": t.base, "tool_calls": t.tool_calls}),
    "chain_stats": lambda t: C.chain_stats(t.sessions),
    **{f"trends_{m}": (lambda t, m=m: C.trends(t.base, m, NOW)) for m in C.TRENDS},
    "sparkline": lambda t: C.sparkline(C.trends(t.base, "tool_calls", NOW)),
    "slow": lambda t: C.slow(t.tool_calls),
    "tokens": lambda t: C.tokens(t.base),
    "export": lambda t: C.export(t.sessions, "2024-01-05", "2024-01-20"),
    "daily_totals": lambda t: C.daily_totals(t.base, "2024-01-08"),
    "label_upsert": lambda t: C.label_newest(t.base, t.config_versions, "stable", NOW),
    "prune_counts": lambda t: C.prune_counts({"events": t.raw, "sessions": t.base, "tool_calls": t.tool_calls}, _SPLIT),
    "sql_passthrough": _sql,
    # live
    "coverage": lambda t: L.coverage(_coverage_input(t), "a3"),
    "provenance_sessions": lambda t: L.provenance_sessions(t.raw),
    "provenance_marked": lambda t: L.provenance_sessions(t.raw.withColumn("tool_input", F.when(F.col("k") % 13 == 0, F.lit('{"_t":"cut","file_path":"x"}')).when(F.col("k") % 13 == 1, F.lit('{"_b":9}')).otherwise(F.col("tool_input")))),
    "provenance_total": lambda t: L.provenance_total(t.raw),
    "gate_decisions": lambda t: L.gate(t.raw),
    "session_diff": lambda t: C.session_diff(t.events, t.base, "u1", "u2"),
    "top_tools": lambda t: C.top_tools(t.raw),
    # relational shapes
    "join_inner_filter": lambda t: t.raw.join(t.base.where("config_version = 'cfg1'").select("session_id", "total_events"), "session_id").select("raw_index", "session_id", "total_events"),
    "join_left_dim": lambda t: t.base.join(t.config_versions, F.col("version_hash") == F.col("config_version"), "left").select("session_id", "description"),
    "join_self_agg": lambda t: (lambda c: c.join(c.where("agent_id IS NOT NULL").groupBy("agent_id").agg(F.count("*").alias("n")), "agent_id", "left").select("session_id", "tool_use_id", "n"))(t.tool_calls),
    "semi_exists": lambda t: t.raw.select("session_id").distinct().join(t.raw.where("event_type = 'PostToolUseFailure'"), "session_id", "left_semi"),
    "in_list": lambda t: t.raw.where(F.col("tool_name").isin("Read", "Grep")).select("raw_index"),
    "paths_intersect": lambda t: t.raw.where("agent_type = 'worker'").select("session_id", "file_path").intersect(t.raw.where("agent_type = 'search'").select("session_id", "file_path")),
    "paths_except": lambda t: t.raw.where("agent_type = 'worker'").select("session_id", "file_path").subtract(t.raw.where("agent_type = 'search'").select("session_id", "file_path")),
    "path_prefix": _path_prefix,
    "like_prefix": lambda t: t.raw.select("session_id").distinct().where(E.any_case_like(F.col("session_id"), "U1%")),
    "like_substring": lambda t: t.raw.where(E.any_case_like(F.col("file_path"), "%/F1%")).select("raw_index"),
    "agg_basic": lambda t: t.projected.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("output_bytes").alias("total"), F.avg("output_bytes").alias("mean"), F.min("output_bytes").alias("low"), F.max("output_bytes").alias("high")),
    "agg_distinct": lambda t: t.raw.groupBy("event_type").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("tool_name").alias("tools")),
    "agg_conditional": lambda t: t.tool_calls.groupBy("tool_name").agg(C.failure_rate().alias("failure_rate")),
    "agg_global": lambda t: t.projected.agg(F.count("*").alias("n"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("total")),
    "agg_nested": lambda t: t.raw.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_size"), F.max("n").alias("max_size")),
    "agg_by_date": lambda t: t.raw.groupBy(E.event_date(F.col("timestamp")).cast("string").alias("day"), "event_type").agg(F.count("*").alias("n")),
    "window_lag": lambda t: N.lagged(t.raw.select("session_id", "event_type", "source_file", *N.ORDER), F.col("event_type"), 1).select("raw_index", F.try_element_at("before", F.lit(-1))["v"].alias("prev")),
    "window_running_sum": lambda t: N.running(t.projected, {"total": F.col("output_bytes")}, ("session_id",)).select("raw_index", "total"),
    "window_row_number": lambda t: N.running(t.raw.select("session_id", *N.ORDER), {"n": F.lit(1)}, ("session_id",)).select("raw_index", F.col("n").cast("int").alias("n")),
    "window_asof_last": lambda t: N.latest(t.raw.where("tool_use_id IS NOT NULL").select("session_id", "tool_use_id", "event_type", *N.ORDER), F.when(F.col("event_type") == "PreToolUse", F.col("timestamp")), ("session_id", "tool_use_id")).select("raw_index", F.col("latest").alias("pre")),
    "topk": lambda t: t.projected.orderBy(F.desc("output_bytes"), "raw_index").limit(20).select("raw_index", "output_bytes"),
    "union_files": lambda t: t.raw.where(F.col("timestamp") < _SPLIT).select("raw_index").unionByName(t.raw.where(F.col("timestamp") >= _SPLIT).select("raw_index")),
    "daily_window": lambda t: t.raw.groupBy(F.window(E.parse_ts(F.col("timestamp")), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
