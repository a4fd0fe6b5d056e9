"""Log files from the wire to the tables: what each kind of line has to give."""

import gzip
import json
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import json_text
from sessionloom.operators import commands as C
from sessionloom.operators import diff, live
from sessionloom.sources import jsonl, legacy_sqlite
from sessionloom.store import Store, config_hash


def line(ts, event, session="s1", h=None, **p):
    e = {"v": 1, "ts": f"2026-02-01T10:00:{ts}Z", "p": {"hook_event_name": event, "session_id": session, **p}}
    return json.dumps(e | ({"h": h} if h is not None else {}), ensure_ascii=False)


HAPPY = [
    line("00.000", "SessionStart", source="startup", cwd="/w", model="m"),
    line("01.000", "UserPromptSubmit", prompt="/go now", prompt_length=7),
    line("02.000", "PreToolUse", tool_name="Read", tool_use_id="t1", tool_input={"file_path": "/a/é.py"}),
    line("02.500", "PostToolUse", tool_name="Read", tool_use_id="t1", tool_response="done"),
    line("09.000", "SessionEnd", reason="exit"),
]


@pytest.fixture
def logs(tmp_path):
    def write(lines, name="hook_logs_2026-02-01.jsonl", packed=False):
        path = tmp_path / (name + ".gz" * packed)
        data = ("\n".join(lines) + "\n").encode()
        path.write_bytes(gzip.compress(data) if packed else data)
        return str(path)

    return write


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("packed", [False, True])
def test_happy_path(store, logs, packed):
    stats = store.ingest([logs(HAPPY, packed=packed)])
    assert stats == {"events_seen": 5, "events_stored": 5, "duplicates": 0, "malformed": 0, "sessions": 1, "tool_calls": 1}
    s = store.table("sessions").first()
    assert (s.started_at, s.ended_at, s.source, s.end_reason, s.model, s.total_tool_calls, s.total_prompts) == ("2026-02-01T10:00:00.000Z", "2026-02-01T10:00:09.000Z", "startup", "exit", "m", 1, 1)
    c = store.table("tool_calls").first()
    assert (c.tool_name, c.duration_ms, c.succeeded, c.output_bytes, c.input_summary) == ("Read", 500, 1, 4, '{"file_path":"/a/\\u00e9.py"}')
    rows = {r.sequence_num: r for r in store.table("events").collect()}
    assert [rows[k].context_cumulative_bytes for k in range(5)] == [0, 7, 35, 39, 39]
    assert rows[1].is_slash_command == 1 and rows[4].reason == "exit" and store.check() == "ok"


def test_ingesting_twice_changes_nothing(store, logs):
    path = logs(HAPPY)
    assert store.ingest([path]) == store.ingest([path])
    more = logs([line("30.000", "PreToolUse", "s2", tool_name="Bash", tool_use_id="x")], "hook_logs_2026-02-02.jsonl")
    assert store.ingest([more])["sessions"] == 2


def test_bad_lines_are_told_apart(spark, logs):
    lines = jsonl.scan(spark, [logs([HAPPY[0], "{not json", "", "  ", '{"v":1,"ts":"x","p":"text"}', '{"v":1,"ts":"x","p":{"session_id":"s"}}', '{"v":-1,"ts":"x","p":{}}', '{"ts":"x","p":{}}', HAPPY[1]])])
    bad = {r.raw_index: r.error for r in jsonl.malformed(lines).collect()}
    assert bad == {1: "JSON parse error", 4: "payload is not a JSON object", 5: "missing hook_event_name or session_id", 6: "JSON parse error", 7: "JSON parse error"}
    assert sorted(r.raw_index for r in jsonl.envelopes(lines).collect()) == [0, 8]


def test_line_numbers_of_split_files(spark, logs):
    path = logs([f"line {i}" * 20 if i % 7 else "" for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = jsonl.scan(spark, [path])
        assert {(r.raw_index, r.raw_line) for r in got.collect()} == {(i, f"line {i}" * 20) for i in range(2000) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_duplicates_use_up_numbers(store, logs):
    e = line("03.000", "PostToolUse", tool_use_id="t1", tool_name="Read", tool_result="r")
    stats = store.ingest([logs([*HAPPY, e, e, line("03.500", "Stop", h="aa"), line("03.600", "Stop", h="aa")])])
    assert stats["events_stored"] == 7 and stats["duplicates"] == 2
    assert store.table("events").agg(F.max("sequence_num")).first()[0] == 8


def test_failures_and_pairing(store, logs):
    store.ingest([logs([
        line("01.000", "PreToolUse", tool_name="Bash", tool_use_id="a", tool_input="ls"),
        line("01.300", "PostToolUseFailure", tool_name="Bash", tool_use_id="a", error="no", is_interrupt=True),
        line("02.000", "PostToolUseFailure", tool_name="Bash", tool_use_id="b", error="später", is_interrupt=0),
        line("03.000", "PreToolUse", tool_name="Late", tool_use_id="b"),
    ])])
    calls = {c.tool_use_id: c for c in store.table("tool_calls").collect()}
    assert calls["a"].duration_ms == 300 and calls["a"].succeeded == 0 and calls["a"].error == "no"
    assert calls["b"].duration_ms == -1000 and calls["b"].started_at == calls["b"].completed_at and calls["b"].input_summary is None
    flags = {e.raw_index: e.is_interrupt for e in store.table("events").collect()}
    assert flags == {0: 0, 1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize(("command", "name", "kind"), [("cat .claude/skills/agents/code-review.md x", "code-review", "agent"), ("see '.claude/skills/system/fmt'", "fmt", "system"), ("ls /tmp", None, None)])
def test_skills(spark, logs, command, name, kind):
    e = jsonl.events(jsonl.envelopes(jsonl.scan(spark, [logs([line("01.000", "PreToolUse", tool_input={"command": command})])]))).first()
    assert (e.skill_name, e.skill_type) == (name, kind)


def test_absent_and_null_results(spark, logs):
    rows = jsonl.events(jsonl.envelopes(jsonl.scan(spark, [logs([line("1.0", "PostToolUse"), line("2.0", "PostToolUse", tool_result=None, tool_response="hidden"), line("3.0", "PostToolUse", tool_response="é")])])))
    assert {r.raw_index: (r.output_bytes, r.tool_result) for r in rows.collect()} == {0: (0, None), 1: (4, None), 2: (2, "é")}


NUMBERS = [("-0.0", "-0.0"), ("1e100", "1e100"), ("1.23456789e-10", "1.23456789e-10"), ("2.0", "2.0"), ("0.00001", "1e-5"), ("3", "3"), ('"a\x7f☃😀"', '"a\\u007f\\u2603\\ud83d\\ude00"'), ('{"b":1,"a":[true,null]}', '{"b":1,"a":[true,null]}'), ("{", None)]


def test_json_text(spark):
    df = spark.createDataFrame([(a,) for a, _ in NUMBERS], "j string").select("j", json_text.compact("j").alias("c"), json_text.canonical("j").alias("s"))
    got = {r.j: r for r in df.collect()}
    assert {k: got[k].c for k, _ in NUMBERS} == dict(NUMBERS)
    assert got['{"b":1,"a":[true,null]}'].s == '{"a":[true,null],"b":1}'
    pairs = [('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("2", "2.0", False), ("x", "x", True), ("x", None, False), (None, None, True), ("[1, 2]", "[1,2]", True)]
    same = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", json_text.equal(F.col("a"), F.col("b")).alias("got"))
    assert all(r.want == r.got for r in same.collect())


def test_discovery(spark, tmp_path):
    for n in ("hook_logs_2026-01-03.jsonl", "hook_logs_2026-01-01.jsonl", "hook_logs_2026-01-02.jsonl.gz", "other.jsonl"):
        (tmp_path / n).write_text("")
    files = jsonl.log_files(spark, str(tmp_path))
    assert [d for d, _ in files] == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert len(jsonl.of_day(files, "2026-01-02")) == 1 and jsonl.scan(spark, jsonl.of_day(files, "2026-01-09")).count() == 0
    assert len(jsonl.unprocessed(files, "2026-01-03")) == 2 and len(jsonl.unprocessed(files, "2026-01-03", True)) == 3
    assert [p[-16:-6] for p in jsonl.newest(files, 1)] == ["2026-01-03"] and len(jsonl.last_days(files, "2026-01-03", 2)) == 2
    assert jsonl.log_files(spark, str(tmp_path / "none")) == [] and jsonl.scan(spark, []).count() == 0


def test_replay_and_tail_lines(spark, logs):
    lines = jsonl.scan(spark, [logs([HAPPY[2], "broken " * 20])])
    rows = {r.line: r for r in jsonl.replay(lines).collect()}
    assert (rows[1].ts, rows[1].session_id, rows[1].event_type) == ("2026-02-01T10:00:02", "s1", "PreToolUse")
    assert rows[2].event_type == "MALFORMED" and len(rows[2].raw) == 81
    shown = {r.raw_index: r.shown for r in jsonl.tail_lines(lines, "read").collect()}
    assert shown[0] == "2026-02-01T10:00:02  s1  PreToolUse                 Read" and shown[1].startswith("[malformed] broken")
    assert 0 not in {r.raw_index for r in jsonl.tail_lines(lines, "bash").collect()}


def test_legacy_lines(spark, logs):
    old = [
        HAPPY[0],
        json.dumps({"phase": "pre", "timestamp": "2026-01-01T00:00:00Z", "session_id": "s", "tool": "Read", "input_summary": "x"}),
        json.dumps({"phase": "post", "ts": "2026-01-01T00:00:01Z", "session_id": "s", "tool_name": "Read", "tool_use_id": "t", "response_summary": "y"}),
        json.dumps({"event_type": "Odd", "session_id": "s", "n": 1}),
        json.dumps({"event_type": "NoSession"}),
        "junk",
    ]
    made = jsonl.normalize_legacy(jsonl.scan(spark, [logs(old)]), "2026-02-02T00:00:00Z").orderBy("raw_index").collect()
    assert [r.raw_index for r in made] == [0, 1, 2, 3] and made[0].raw_line == HAPPY[0]
    one, two, three = (json.loads(r.raw_line) for r in made[1:])
    assert one["p"]["tool_input"] == {"_legacy_summary": "x"} and one["p"]["tool_use_id"].startswith("legacy_") and one["ts"] == "2026-01-01T00:00:00Z"
    assert two["p"]["tool_response"] == "y" and two["p"]["tool_use_id"] == "t"
    assert three["p"]["hook_event_name"] == "Odd" and three["p"]["n"] == 1 and three["ts"] == "2026-02-02T00:00:00Z"


def test_legacy_sqlite(spark, tmp_path):
    path = tmp_path / "old.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE events (timestamp TEXT, event_type TEXT, session_id TEXT, tool_name TEXT, extra INT)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, 1)", [("2026-01-02", "Stop", "b", None), ("2026-01-01", "PreToolUse", "a", "Read")])
    for n in (50_000, 1):
        rows = jsonl.envelopes(legacy_sqlite.read_events(spark, str(path), n)).orderBy("ts").collect()
        assert [r.raw_index for r in rows] == [2, 1]
    assert [json.loads(r.raw_line)["p"] for r in rows] == [{"hook_event_name": "PreToolUse", "session_id": "a", "tool_name": "Read"}, {"hook_event_name": "Stop", "session_id": "b"}]


def test_legacy_sqlite_is_read_whole(spark, tmp_path):
    path = tmp_path / "old.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE events (timestamp TEXT, event_type TEXT, session_id TEXT)")
        assert legacy_sqlite.read_events(spark, str(path)).count() == 0
        con.executemany("INSERT INTO events VALUES ('2026-01-01', 'Stop', ?)", [(f"s{i}",) for i in range(12_000)])
    assert legacy_sqlite.read_events(spark, str(path), 5_000).select("raw_index").distinct().count() == 12_000


def test_user_tables_and_maintenance(store, logs, tmp_path):
    store.ingest([logs([*HAPPY, line("20.000", "SessionStart", "old", config_version="c1")])])
    assert store.annotate("S1", "good", None, "2026-02-02") == 1 and store.annotate("none", "x", None, "2026-02-02") == 0
    store.label("stable", "2026-02-02")
    assert store.table("annotations").first().label == "good" and store.table("config_versions").first().description == "stable"
    assert store.sql("SELECT count(*) AS n FROM events").first().n == 6
    with pytest.raises(PermissionError):
        store.sql("  drop table events")
    store.backup(str(tmp_path / "copy"))
    assert diff.events_diff(store.table("events"), Store(store.spark, str(tmp_path / "copy")).table("events")).count() == 0
    assert {r.key: r.value for r in store.prune("2026-02-02").collect()} == {"events_count": 6, "sessions_count": 2, "tool_calls_count": 1}
    assert store.table("events").count() == 0 and store.table("annotations").count() == 1


def test_store_before_ingest(store):
    assert store.check() == "empty" and store.table("annotations").count() == 0
    with pytest.raises(LookupError):
        store.table("events")


def test_coverage_from_logs(spark, logs):
    use = lambda ts, tool, **i: line(ts, "PreToolUse", agent_id="a", agent_type="search", tool_name=tool, tool_input=i)
    events = jsonl.events(jsonl.envelopes(jsonl.scan(spark, [logs([use("1.0", "Read", file_path="/x/y/z.py"), use("2.0", "Read", file_path="/r.py"), use("3.0", "Glob", pattern="*.a"), use("4.0", "Glob", pattern="*.b"), use("5.0", "Grep", pattern="q"), use("6.0", "Grep", pattern="q")])])))
    got = {(r.kind, r.item) for r in live.coverage(events, "a").collect()}
    assert got == {("read", "/x/y/z.py"), ("read", "/r.py"), ("dir", "/x/y"), ("dir", "/"), ("glob", "<redacted:1>"), ("glob", "<redacted:2>"), ("grep", "<redacted:1>")}


def test_session_by_prefix_ignores_case(store, logs):
    store.ingest([logs(HAPPY)])
    assert C.session_timeline(store.table("events"), store.table("sessions"), "S").count() == 5
    assert C.chain(store.table("sessions"), "s1").count() == 0


def test_what_is_known_at_ingest_wins(store, logs):
    store.ingest([logs([line("01.000", "SessionStart", cwd="/w", git_branch="old", config_version="p"), line("02.000", "Stop", cwd="/else", git_branch="kept")])], config_version=config_hash([b"a", b"b"]), git={"/w": ("main", "abc")})
    got = {r.raw_index: (r.config_version, r.git_branch, r.git_commit) for r in store.table("events").collect()}
    assert got == {0: ("fb8e20fc", "main", "abc"), 1: ("fb8e20fc", "kept", None)}
    store.rebuild()
    assert store.table("sessions").first().git_branch == "main"


def test_command_line(spark, logs, tmp_path, capsys, monkeypatch):
    from sessionloom import cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    folder = str(tmp_path / "cli")
    path = logs(HAPPY)
    go = lambda *a: (cli.main(["--store", folder, "--logs", str(tmp_path), "--now", "2026-02-02", *a]), capsys.readouterr().out)[1]
    assert "'sessions': 1" in go("ingest")
    assert "2026-02-01" in go("summary") and "Read" in go("tools") and "happy" not in go("sessions")
    assert "UserPromptSubmit" in go("session", "s1") and '"n": 5' in go("--format", "json", "sql", "SELECT count(*) AS n FROM events")
    assert "store: ok" in go("health") and "/go now" not in go("search", "go") and go("annotate", "s1", "good").strip() == "1"
    old = tmp_path / "old.jsonl"
    old.write_text(json.dumps({"phase": "pre", "ts": "2026-01-01T00:00:00Z", "session_id": "z", "tool": "Read"}) + "\n")
    assert "'sessions': 2" in go("import-legacy", str(old))
    assert path


def day(n, session="s1"):
    return [line("01.000", "SessionStart", session, source="startup", cwd="/w").replace("2026-02-01", f"2026-02-{n:02}"), line("02.000", "PreToolUse", session, tool_name="Read", tool_use_id=f"t{n}").replace("2026-02-01", f"2026-02-{n:02}")]


def test_pruned_rows_do_not_come_back(store, logs):
    store.ingest([logs(day(1, "old"), "hook_logs_2026-02-01.jsonl")])
    store.ingest([logs(day(5, "new"), "hook_logs_2026-02-05.jsonl")])
    assert {r.key: r.value for r in store.prune("2026-02-03").collect()} == {"events_count": 2, "sessions_count": 1, "tool_calls_count": 0}
    store.ingest([logs(day(6, "next"), "hook_logs_2026-02-06.jsonl")])
    assert {r.session_id for r in store.table("sessions").collect()} == {"new", "next"} and store.table("events").count() == 4
    store.rebuild()
    assert {r.session_id for r in store.table("sessions").collect()} == {"new", "next"} and store.table("events").count() == 4
    assert {r.key: r.value for r in store.prune("2020-01-01").collect()} == {"events_count": 0, "sessions_count": 0, "tool_calls_count": 0}


def whole(store):
    """All tables' rows, without the order of rows."""
    return {t: sorted(map(str, store.table(t).select(*sorted(store.table(t).columns)).collect())) for t in ("events", "session_rows", "tool_call_rows", "sessions", "tool_calls")}


def test_one_more_day_leaves_other_parts_alone(spark, logs, tmp_path):
    store = Store(spark, str(tmp_path / "many"), buckets=16)
    store.ingest([logs([x for i in range(12) for x in day(1, f"s{i}")], "hook_logs_2026-02-01.jsonl")])
    before = store.current()
    stats = store.ingest([logs([*day(2, "s3"), *day(2, "other")], "hook_logs_2026-02-02.jsonl")])
    after = store.current()
    assert stats["events_seen"] == 4 and stats["sessions"] == 13
    for name in ("lines", "events"):
        assert set(after[name]) > set(before[name]) and len(after[name]) == len(before[name]) + 1
    touched = {r[0] for r in store.table("sessions").where("session_id IN ('s3', 'other')").select(store.bucket()).collect()}
    for name in ("session_rows", "tool_call_rows", "tool_calls", "sessions"):
        new = {p.partition("_part=")[2] for p in set(after[name]) - set(before[name])}
        assert new <= touched and all(p in after[name] for p in before[name] if p.partition("_part=")[2] not in touched | {"none"}), name
    counts = {r.session_id: (r.total_events, r.started_at[:10]) for r in store.table("sessions").collect()}
    assert counts["s3"] == (4, "2026-02-01") and counts["other"] == (2, "2026-02-02")
    one = whole(store)
    store.rebuild()
    assert whole(store) == one
    store.rebuild(since="2026-02-02")
    assert whole(store) == one


def test_a_log_that_grows_and_one_that_is_another(store, logs):
    path = logs([*day(1, "a"), *day(1, "b")])
    store.ingest([path])
    logs([*day(1, "a"), *day(1, "b"), line("30.000", "Stop", "a")])
    assert store.ingest([path])["events_stored"] == 5 and store.table("lines").count() == 5
    assert {r.session_id: r.total_events for r in store.table("sessions").collect()} == {"a": 3, "b": 2}
    logs(day(3, "c"))  # the name is used for another log: nothing goes
    assert store.ingest([path])["sessions"] == 3 and store.table("events").count() == 7 and store.table("lines").count() == 7
    logs([*day(3, "c"), *day(3, "d")])
    assert store.ingest([path])["sessions"] == 4 and store.table("lines").count() == 9
    one = whole(store)
    store.rebuild()
    assert whole(store) == one


def test_logs_of_several_hosts(store, tmp_path):
    paths = []
    for host in ("A", "B"):
        (tmp_path / host).mkdir()
        paths.append(tmp_path / host / "hook_logs_2026-02-01.jsonl")
        paths[-1].write_text("\n".join([*day(1, f"{host}1"), *day(1, "both")]) + "\n")
    assert store.ingest([str(paths[0])])["sessions"] == 2
    stats = store.ingest([str(paths[1])])
    assert stats["sessions"] == 3 and stats["duplicates"] == 2 and store.table("lines").count() == 8
    assert {r.session_id: r.total_events for r in store.table("sessions").collect()} == {"A1": 2, "B1": 2, "both": 2}
    together = Store(store.spark, str(tmp_path / "together"))
    together.ingest(list(map(str, paths)))
    assert whole(together)["events"] == whole(store)["events"] and whole(together)["sessions"] == whole(store)["sessions"]


def test_legacy_logs_of_several_projects(spark, store, tmp_path, capsys, monkeypatch):
    from sessionloom import cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    for p in "pqr":
        folder = tmp_path / f"home/code/{p}/.claude/logs"
        folder.mkdir(parents=True)
        old = [json.dumps({"phase": "pre", "ts": f"2026-01-01T00:00:0{i}Z", "session_id": f"{p}{i}", "tool": "Read"}) for i in range(2)]
        (folder / "log.jsonl").write_text("\n".join(old) + "\n")
    store.ingest_lines(spark.createDataFrame([("log.jsonl", 0, HAPPY[0])], "source_file string, raw_index long, raw_line string"))
    cli.main(["--store", store.folder, "--now", "2026-02-02", "import-legacy", str(tmp_path / "home")])
    assert "'sessions': 7" in capsys.readouterr().out and store.table("events").count() == 7


def test_a_failed_ingest_leaves_the_old_state(store, logs, monkeypatch):
    from sessionloom.operators import enrich

    store.ingest([logs(day(1, "a"))])
    one, pointers = whole(store), store.current()
    again = logs([*day(1, "a"), *day(2, "b")])

    def fail(*a, **k):
        raise RuntimeError("fault")

    for step in ("_named", "_write", "session_rows", "fold_tool_calls", "relinked", "_point"):
        with monkeypatch.context() as m:
            m.setattr(*(Store, step) if step.startswith("_") else (enrich, step), fail)
            with pytest.raises(RuntimeError, match="fault"):
                store.ingest([again])
        assert store.current() == pointers
    assert whole(store) == one
    assert store.ingest([again])["sessions"] == 2


def test_pruned_sessions_do_not_come_back_at_rebuild(store, logs):
    store.ingest([logs([*day(1, "s1"), *day(2, "s1"), line("03.000", "PostToolUse", "s1", tool_use_id="t1").replace("2026-02-01", "2026-02-02"), *day(2, "s2"), "{broken"])])
    store.prune("2026-02-02")
    one = whole(store)
    assert {r.session_id for r in store.table("sessions").collect()} == {"s2"} and store.table("events").count() == 5
    store.rebuild()
    assert whole(store) == one
    store.ingest([logs(day(3, "s1"), "hook_logs_2026-02-03.jsonl")])
    assert {r.session_id: r.started_at[:10] for r in store.table("sessions").collect()} == {"s1": "2026-02-03", "s2": "2026-02-02"}
    one = whole(store)
    store.rebuild()
    assert {k: v for k, v in whole(store).items() if k != "events"} == {k: v for k, v in one.items() if k != "events"}
    store.prune("2027-01-01")
    assert store.table("lines").count() == 1 and store.table("events").count() == 0


def test_search_reads_the_parts_of_its_words(store, logs, monkeypatch):
    from sessionloom import store as stores
    from sessionloom.operators import search

    monkeypatch.setattr(stores, "CROWDED", 2)
    said = lambda n, i, text: line(f"{i:02}.000", "UserPromptSubmit", f"s{n}", prompt=text).replace("2026-02-01", f"2026-02-0{n}")
    for n in (1, 2, 3, 4):
        path = logs([said(n, i, f"word{i % 3} common {'rare' if i == n else ''} Größe") for i in range(6)], f"hook_logs_2026-02-0{n}.jsonl")
        store.ingest([path])
    logs([said(4, i, f"word{i % 3} common {'rare' if i == 4 else ''} Größe") for i in range(6)] + [said(4, 7, "rare again")], "hook_logs_2026-02-04.jsonl")
    store.ingest([path])

    def same():
        plain = search.build(store.table("events"), "event_hash", stores.TEXTS)
        for asked in (["rare"], ["common", "RARE"], ["große"], ["none"], ["word1", "common"]):
            want = search.ranked(plain, asked, search.all_of(*[search.term(plain, w) for w in asked]))
            got = store.search(asked)
            assert {(r.event_hash, round(r.score, 9)) for r in got.collect()} == {(r.id, round(r.score, 9)) for r in want.collect()}, asked
        read = {f.rpartition("/")[0].partition("_part=")[2] for f in store.search(["rare"]).inputFiles() if "/postings/" in f}
        assert len(read) == 1 and len({stores.part_key(p) for p in store.current()["postings"]}) > 5

    same()
    assert max(Counter(map(stores.part_key, store.current()["postings"])).values()) <= 3
    store.prune("2026-02-03")
    same()
    store.rebuild()
    same()


def test_clean_deletes_what_no_version_names(store, logs):
    for n in (1, 2, 3):
        store.ingest([logs(day(n, f"s{n}"), f"hook_logs_2026-02-0{n}.jsonl")])
    one = whole(store)
    store.rebuild()
    store.rebuild()
    assert store.clean() > 0 and store.clean() == 0
    assert whole(store) == one


def test_stored_hashes_stay_where_they_are(spark):
    from sessionloom.operators import enrich

    cols = "event_hash string, timestamp string, raw_index long, source_file string"
    spark.createDataFrame([(f"{i:016x}", "t", i, "f") for i in range(500)], cols).write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/hashes")
    stored = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/hashes")
    batch = spark.createDataFrame([(f"{i:016x}", "t", i, "g") for i in range(450, 550)], cols)
    for n in (100, None, 10**9):
        assert sorted(r.raw_index for r in enrich.first_of_hash(batch, stored, n).collect()) == list(range(500, 550))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = enrich.first_of_hash(batch, stored, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x or "Scan parquet" in x)
    join = max(i for i in range(at) if "BroadcastHashJoin" in lines[i] and "LeftSemi" in lines[i])
    assert not any("Exchange hashpartitioning" in x for x in lines[join:at])


def test_pointers(store, logs, tmp_path):
    store.init()
    assert store.check() == "ok" and store.table("events").count() == 0
    for n in (1, 2):
        store.ingest([logs(day(n), f"hook_logs_2026-02-0{n}.jsonl")])
    pointers = sorted((tmp_path / "store").glob("CURRENT-*.json"))
    assert len(pointers) == 2
    pointers[-1].unlink()  # as if the last write had not happened: the one before still names whole tables
    assert {r.session_id for r in store.table("sessions").collect()} <= {"s1"} and store.table("lines").count() >= 2


def test_export_is_not_cut(spark, tmp_path, capsys, monkeypatch):
    from sessionloom import cli
    from sessionloom.render import render

    many = spark.range(10_001).selectExpr("format_string('s%05d', id) AS session_id", "'2026-02-01T00:00:00Z' AS started_at", "'abc' AS git_commit")
    folder = str(tmp_path / "many")
    Store(spark, folder).write(sessions=many)
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    cli.main(["--store", folder, "--out", str(tmp_path / "out"), "export"])
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 10_001 and got[0]["git_commit"] == "abc"
    capsys.readouterr()
    cli.main(["--store", folder, "export", "2026-02-01"])
    assert len(capsys.readouterr().out.splitlines()) == 10_001
    assert render(many).endswith("(only the first 10000 rows are shown)")
    with pytest.raises(ValueError, match="more than"):
        render(many, "csv")


def test_truncated_inputs_have_no_paths(spark, logs):
    use = lambda ts, who, tool, **i: line(ts, "PreToolUse", agent_type=who, tool_name=tool, tool_input=i)
    events = jsonl.events(jsonl.envelopes(jsonl.scan(spark, [logs([use("1.0", "search", "Read", file_path="/a", _t="cut"), use("2.0", "worker", "Edit", file_path="/a"), use("3.0", "worker", "Edit", file_path="/b", _b=9)])])))
    assert live.provenance_total(events).first().total_coverage_edge_incidents == 1


def test_inventory(spark, tmp_path):
    for n in ("hook_logs_2026-01-03.jsonl", "hook_logs_2026-01-01.jsonl.gz", "hook_logs_2026-01-02.jsonl"):
        (tmp_path / n).write_text("xx")
    got = [tuple(r) for r in jsonl.inventory(spark, str(tmp_path), "2026-01-03").collect()]
    assert got == [("active", 1, 2, "2026-01-03", "2026-01-03"), ("archived", 1, 2, "2026-01-01", "2026-01-01"), ("waiting", 1, 2, "2026-01-02", "2026-01-02")]
    assert jsonl.inventory(spark, str(tmp_path / "none"), "2026-01-03").count() == 0


def test_ingest_by_age(store, logs):
    path = logs(HAPPY)
    assert store.ingest_if_older(lambda: [path], 3600)["sessions"] == 1
    assert store.ingest_if_older(lambda: 1 / 0, 3600) is None
    assert store.ingest_if_older(lambda: [path], 0)["events_seen"] == 5


def test_legacy_discovery(spark, tmp_path):
    for name in ("code/p/.claude/logs/b.jsonl", "code/p/.claude/logs/a.jsonl.gz", "code/p/deep/.claude/logs/x.jsonl", "repos/q/.claude/logs/c.jsonl", ".claude/logs/d.jsonl", ".claude/logs/e.jsonl.gz", ".local/share/claude/logs/f.jsonl"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
    assert [p.rpartition("/")[2] for p in jsonl.legacy_files(spark, str(tmp_path))] == ["b.jsonl", "a.jsonl.gz", "c.jsonl", "d.jsonl", "f.jsonl"]
    assert jsonl.legacy_files(spark, str(tmp_path / "none")) == []
