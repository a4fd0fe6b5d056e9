"""Cases that the benchmark data do not hold."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.operators import commands as C
from sessionloom.operators import diff, enrich, live, policy, search
from sessionloom.plans.adapter import telemetry
from sessionloom.render import render
from sessionloom.runtime import materialize, scratch_dir
from sessionloom.store import USER_TABLES, known


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("ms", "shown"), [(None, ""), (0, "0ms"), (999, "999ms"), (1500, "1.5s"), (59999, "60.0s"), (65000, "1m5s")])
def test_durations(spark, ms, shown):
    assert spark.createDataFrame([(ms,)], "x long").select(E.fmt_duration(F.col("x"))).first()[0] == shown


@pytest.mark.parametrize(("n", "shown"), [(None, ""), (500, "500B"), (2048, "2.0K"), (2 << 20, "2.0M")])
def test_bytes(spark, n, shown):
    assert spark.createDataFrame([(n,)], "x long").select(E.fmt_bytes(F.col("x"))).first()[0] == shown


@pytest.mark.parametrize(("ts", "norm"), [("2026-01-01T00:00:00Z", "2026-01-01T00:00:00.000000+00:00"), ("2026-01-01T00:00:00.1234567+00:00", "2026-01-01T00:00:00.123456+00:00"), ("2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00+02:00"), ("junk", "junk")])
def test_times(spark, ts, norm):
    assert one(spark, E.normalize_ts(F.col("x")), x=ts) == norm
    assert (one(spark, E.parse_ts(F.col("x")), x=ts) is None) == (ts == "junk")


@pytest.mark.parametrize(("path", "parent", "above"), [("/a/b.py", "/a", ["/", "/a", "/a/b.py"]), ("/a", "/", ["/", "/a"]), ("a/b", "a", ["a", "a/b"]), ("a", None, ["a"])])
def test_paths(spark, path, parent, above):
    assert one(spark, E.parent_dir(F.col("x")), x=path) == parent
    assert one(spark, E.ancestors(F.col("x")), x=path) == above


def test_hash_on_the_wire_wins(spark):
    import hashlib

    cols = [F.lit("s"), F.lit("Stop"), F.lit("t"), F.lit(None).cast("string")]
    assert one(spark, E.event_hash(*cols), x=1) == hashlib.sha256(b"s|Stop|t|").hexdigest()[:16]
    assert one(spark, E.event_hash(*cols, F.lit("")), x=1) == ""


def test_sparkline(spark):
    days = spark.createDataFrame([("a", 0.0), ("b", 4.0), ("c", 8.0)], "date string, value double")
    assert C.sparkline(days).first()[0] == " ▄█"
    assert C.sparkline(days.withColumn("value", F.lit(0.0))).first()[0] == "   "


SESSION = "session_id string, started_at string, ended_at string, source string, cwd string, git_branch string, model string, end_reason string"


def at(minute, second=0):
    return f"2026-01-01T{10 + minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


def lineage(spark, *rows):
    made = enrich.parents(spark.createDataFrame([(*r, "/w", "b", "m", e) for *r, e in rows], SESSION))
    return {r.session_id: (r.parent_session_id, r.score) for r in made.collect()}


def test_lineage_sums_and_threshold(spark):
    assert lineage(spark, ("p", at(0), at(10), "startup", "exit"), ("c", at(10, 20), at(20), "resume", None)) == {"c": ("p", 13)}
    assert lineage(spark, ("p", at(0), at(10), "compact", "exit"), ("c", at(10, 20), at(20), "resume", None)) == {}
    assert lineage(spark, ("p", at(0), at(10), "startup", "exit"), ("c", at(10, 20), at(20), "compact", None)) == {}


def test_lineage_takes_the_first_beyond_the_look_back(spark):
    rows = [("old", at(0), at(1), "startup", "exit"), ("older", at(0), at(0, 30), "startup", "exit"), ("c", at(200), at(201), "startup", None)]
    assert lineage(spark, *rows) == {"c": ("old", 8)}


def test_lineage_prefers_the_better_and_then_the_newer(spark):
    rows = [("a", at(0), at(10), "startup", "exit"), ("b", at(0), at(11), "startup", "logout"), ("c", at(12), at(13), "startup", None)]
    assert lineage(spark, *rows)["c"] == ("a", 11)
    rows = [("a", at(0), at(11, 1), "startup", "exit"), ("b", at(0), at(11, 2), "startup", "exit"), ("c", at(12), at(13), "startup", None)]
    assert lineage(spark, *rows)["c"][0] == "b"


def test_chains_lead_to_the_root(spark):
    edges = spark.createDataFrame([(f"s{i}", f"s{i - 1}") for i in range(1, 20)] + [("x", "y")], "session_id string, parent_session_id string")
    assert {r.session_id: r.chain_id for r in enrich.chains(edges).collect()} == {**{f"s{i}": "s0" for i in range(1, 20)}, "x": "y"}


def test_sessions_go_through_their_events_once(spark, sf):
    events = materialize(enrich.enrich(telemetry(spark, sf)))
    whole = enrich.sessions(events)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    apart = enrich.fold_sessions(enrich.session_rows(events)).join(enrich.counters(events), "session_id")
    assert whole.columns == apart.columns and sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)


def test_what_is_known_of_files_goes_to_the_events(spark):
    events = spark.createDataFrame([(f"f{i % 3}", "/w", None, None, None) for i in range(20)], "source_file string, cwd string, config_version string, git_branch string, git_commit string")
    lines = events.select("source_file", F.lit("v1").alias("config_version"), F.lit('{"/w":["main","abc"]}').alias("git"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = known(events, lines)
        # neither the events are sent around nor dealt by the few files
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in joined.collect()} == {(f"f{i}", "/w", "v1", "main", "abc") for i in range(3)} and joined.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_what_leads_into_a_ring_has_no_chain(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("self", "self")]
    line = [(f"s{i}", f"s{i - 1}") for i in range(1, 12)]
    found = lambda rows: {r.session_id: r.chain_id for r in enrich.chains(spark.createDataFrame(rows, "session_id string, parent_session_id string")).collect()}
    assert found(ring + line) == {f"s{i}": "s0" for i in range(1, 12)}
    assert found(ring) == {} and found(ring[:1]) == {"a": "b"}


def test_rings_are_kept_up_by_increments(spark):
    # a log that lacks its first start: the session ends before it starts
    made = lambda *rows: spark.createDataFrame([(i, s, e, "startup", "/w", "b", "m", "exit") for i, s, e in rows], SESSION)
    shown = lambda df: {r.session_id: (r.parent_session_id, r.chain_id) for r in df.select("session_id", "parent_session_id", "chain_id").collect()}
    ring = [("a", at(20), at(10)), ("b", at(21), at(9)), ("c", at(40), at(41))]
    one = materialize(enrich.with_lineage(made(*ring)))
    assert shown(one) == {"a": ("b", None), "b": ("a", None), "c": ("a", None)}
    for more in ([("d", at(42), at(50))], [("a", at(5), at(10))], [("b", at(21), at(30)), ("d", at(42), at(50))]):
        now = {r[0]: r for r in ring} | {r[0]: r for r in more}
        whole = made(*now.values())
        kept = whole.join(one.select("session_id", "parent_session_id", "chain_id"), "session_id", "left")
        moved = shown(enrich.relinked(kept, one, whole.where(F.col("session_id").isin([r[0] for r in more])).select("session_id")))
        assert shown(one) | moved == shown(enrich.with_lineage(whole))


def test_a_later_error_makes_a_call_fail(spark):
    cols = "source_file string, session_id string, raw_index long, tool_use_id string, tool_name string, agent_id string, agent_type string, started_at string, completed_at string, duration_ms long, input_summary string, output_bytes long, error string, succeeded long, skill_name string, skill_type string"
    row = lambda i, error, ok: ("f", "s", i, "t", f"tool{i}", None, None, "a", f"b{i}", i, None, 1, error, ok, None, None)
    fold = lambda *rows: enrich.fold_tool_calls(spark.createDataFrame(list(rows), cols)).first()
    assert fold(row(1, None, 1), row(2, "e", 0)).succeeded == 0
    assert fold(row(1, None, 1), row(2, None, 0)).succeeded == 1
    assert fold(row(1, "e", 0), row(2, None, 1)).succeeded == 0
    last = fold(row(1, "e", 0), row(2, None, 1))
    assert (last.tool_name, last.error, last.completed_at, last.duration_ms) == ("tool1", "e", "b2", 2)


def test_running_sums_cross_hours(spark):
    rows = [("f", "s", f"2026-01-01T{h:02d}:00:0{i}Z", h * 10 + i, 1 + h) for h in range(5) for i in range(3)]
    df = spark.createDataFrame(rows, "source_file string, session_id string, timestamp string, raw_index long, v long")
    got = {r.raw_index: r.total for r in enrich.running(df, {"total": F.col("v")}).collect()}
    total = 0
    for r in rows:
        total += r[4]
        assert got[r[3]] == total


def test_gate_warns_once(spark):
    e = lambda i, who, path, tool="Edit": ("PreToolUse", "s", who, tool, path, f"t{i:02d}", i)
    rows = [e(0, "worker", "/a/x"), e(1, "search", "/a/y", "Read"), e(2, "worker", "/a/z"), e(3, "worker", "/b/z"), e(4, "worker", "/b/z"), e(5, "search", "/b/q", "Grep"), e(6, "worker", "/b/z"), e(7, "worker", "/c")]
    df = spark.createDataFrame(rows, "event_type string, session_id string, agent_type string, tool_name string, file_path string, timestamp string, raw_index long")
    got = {r.raw_index: r.decision for r in live.gate(df).collect()}
    assert got == {0: "allow", 2: "allow", 3: "warn", 4: "allow", 6: "allow", 7: "warn"}


def test_search(spark):
    docs = spark.createDataFrame([(1, "The Café, the fox"), (2, "fox runs; cafe closed"), (3, None), (4, "foxes run the the the")], "id long, t string")
    index = search.build(docs, "id", ["t"])
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(search.term(index, "CAFÉ")) == {1, 2} and ids(search.prefix(index, "fox")) == {1, 2, 4}
    assert ids(search.phrase(index, ["the", "fox"])) == {1} and ids(search.near(index, "fox", "cafe", 2)) == {1, 2}
    assert ids(search.but_not(search.prefix(index, "fox"), search.term(index, "the"))) == {2}
    assert [r.id for r in search.ranked(index, ["the"]).collect()] == [4, 1]
    assert ids(search.all_of(search.term(index, "fox"), search.any_of(search.term(index, "runs"), search.term(index, "zzz")))) == {2}


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", '{"a":1,"b":2}'), (2, "y", None), (3, "z", "1")], "k long, v string, j string")
    b = spark.createDataFrame([(1, "x", '{"b":2,"a":1}'), (2, "Y", None), (4, "z", "1")], "k long, v string, j string")
    got = {tuple(r) for r in diff.table_diff(a, b, ["k"], json=("j",)).collect()}
    assert got == {("2", "differs", "v", "y", "Y"), ("3", "only_a", None, None, None), ("4", "only_b", None, None, None)}
    assert {(r.kind, r.field, r.n) for r in diff.report(diff.table_diff(a, b, ["k"], json=("j",))).collect()} == {("differs", "v", 1), ("only_a", None, 1), ("only_b", None, 1)}


@pytest.mark.parametrize(
    ("agent", "tool", "command", "target", "bypass", "denied"),
    [
        ("Worker ", "Bash", "cd /x && git status -s", None, False, None),
        ("worker", "Bash", "git push", None, False, "command not allowed"),
        ("worker", "Bash", "/usr/bin/sudo ls", None, False, "wrapper command"),
        ("worker", "Bash", "git status; git status", None, False, "composed command"),
        ("worker", "Bash", "git status > f", None, False, "composed command"),
        ("worker", "mcp_a", None, None, False, None),
        ("worker", "Write", None, None, False, "tool not allowed"),
        ("stranger", "Bash", "ls", None, False, "unknown agent"),
        (None, "Task", None, "worker", False, None),
        (None, "Task", None, "worker", True, "bypassed permissions"),
        (None, "Task", None, "other", False, "target not allowed"),
    ],
)
def test_policy(spark, agent, tool, command, target, bypass, denied):
    make = spark.createDataFrame
    rules = policy.Rules(make([("worker", "w"), ("", "main")], "agent string, profile string"), make([("w", "Bash"), ("w", "mcp_*"), ("main", "Task")], "profile string, tool string"), make([("main", "worker")], "profile string, target string"), make([("w", "git status")], "profile string, words string"))
    calls = make([(1, agent, tool, command, target, bypass)], "call_id long, agent_type string, tool_name string, command string, target string, bypass boolean")
    assert policy.audit(calls, rules).first().denied == denied


RULES = """
[profiles._default]
aliases = ["", "main"]
tools = ["Task"]
[[profiles._default.agent.spawn.allow]]
profile = "worker"
[[profiles._default.agent.spawn.allow]]
profile = "free"
may-bypass = true
[profiles.worker]
aliases = ["Helper"]
tools = ["Bash", "Read"]
mcp-tools = ["mcp_*"]
safety-overrides = ["push"]
[profiles.worker.commands]
categories = ["git"]
[profiles.free]
[command-categories.git]
allow = [["git", "status"], ["git", "push"]]
[safety.push]
kind = "deny-always"
message = "no"
[safety.push.command]
prefix = ["git", "push"]
"""


def test_rules_of_a_file(spark):
    rules = policy.read_rules(spark, RULES)
    make = [("helper", "Bash", "git status -s", None, False), ("WORKER", "Bash", "git log", None, False), ("worker", "mcp_x", None, None, False), ("main", "Task", None, "helper", False), (None, "Task", None, "helper", True), (None, "Task", None, "free", True)]
    calls = spark.createDataFrame([(k, *c) for k, c in enumerate(make)], "call_id long, agent_type string, tool_name string, command string, target string, bypass boolean")
    got = {r.call_id: r.denied for r in policy.audit(calls, rules).collect()}
    assert got == {0: None, 1: "command not allowed", 2: None, 3: None, 4: "bypassed permissions", 5: None}


@pytest.mark.parametrize(
    ("old", "new", "wrong"),
    [
        ("_default", "other", "no profile _default"),
        ('"Read"]', '"Raed"]', "unknown tool Raed"),
        ('categories = ["git"]', 'categories = ["hg"]', "unknown command category hg"),
        ('safety-overrides = ["push"]', 'safety-overrides = ["pull"]', "unknown safety override pull"),
        ('"Helper"]', '"MAIN "]', "the name main is taken"),
        ('profile = "free"', 'profile = "gone"', "unknown spawn target gone"),
        ('prefix = ["git", "push"]', 'prefix = ["git", "push", "-f"]', "override push is for no command"),
    ],
)
def test_wrong_rules(spark, old, new, wrong):
    with pytest.raises(ValueError, match=wrong):
        policy.read_rules(spark, RULES.replace(old, new))


GUARDS = """
[profiles._default]
aliases = ["", "main"]
[profiles.w]
tools = ["Bash"]
safety-overrides = ["waived"]
[profiles.w.commands]
categories = ["all"]
structure = { single-command = true, no-redirection = true, allow-pipeline = true }
[profiles.loose]
tools = ["Bash"]
[profiles.loose.commands]
categories = ["all"]
[command-categories.all]
allow = [["git"], ["rm"], ["curl"], ["docker"], ["jq"], ["show"], ["mvn", "test"]]
[safety]
waived = { kind = "deny-always", command = { prefix = ["git"] }, message = "waived" }
recursive = { kind = "deny-flags", command = { prefix = ["rm"] }, flags = ["-r", "--recursive"], message = "recursive" }
place = { kind = "require-positional-prefix", command = { prefix = ["show"] }, prefixes = ["/tmp/"], message = "place" }
url = { kind = "require-curl-url-prefix", command = { prefix = ["curl"] }, prefixes = ["https://a.b"], message = "url" }
header = { kind = "allow-curl-headers", command = { prefix = ["curl"] }, prefixes = ["Accept: "], message = "header" }
method = { kind = "allow-curl-methods", command = { prefix = ["curl"] }, prefixes = ["GET"], message = "method" }
form = { kind = "allow-curl-forms", command = { prefix = ["curl"] }, targets = ["https://a.b/up"], prefixes = ["f=@/tmp/"], message = "form" }
paths = { kind = "require-explicit-pathspecs", command = { prefix = ["git", "add"] }, forbid = [".", "-A"], message = "paths" }
push = { kind = "require-explicit-push-target", command = { prefix = ["git", "push"] }, message = "push" }
branch = { kind = "deny-protected-branch", command = { prefix = ["git", "push"] }, branches = ["main"], message = "branch" }
logs = { kind = "require-bounded-logs", command = { prefix = ["docker", "logs"] }, message = "logs" }
rebase = { kind = "deny-always", command = { prefix = ["git", "rebase"] }, allow-exact = [["git", "rebase", "o/m"]], message = "rebase" }
remove = { kind = "deny-subcommands", command = { prefix = ["docker"] }, subcommands = [["rm"], ["volume", "rm"]], message = "remove" }
"""

GUARDED = [
    ("rm a", None), ("rm -fr a", "recursive"), ("rm --recursive=x a", "recursive"), ("rm --force a", None), ("rm -- -x", None),
    ("show -v /tmp/x", None), ("show -v /etc/x", "place"), ("show", "place"),
    ("curl https://a.b/c", None), ("curl -s 'https://a.b/c'", None), ("curl https://c.d", "url"), ("curl", "url"), ("curl -o https://a.b x", "url"),
    ("curl --url=https://a.b", None), ("curl --url https://a.b", None), ("curl -- https://a.b", None), ("curl -d x https://a.b", None),
    ('curl -H "Accept: x; y" https://a.b', None), ("curl -s https://a.b -H 'X: y'", "header"), ("curl https://a.b -HX:y", "header"), ("curl https://a.b --header=X:y", "header"),
    ("curl -X get https://a.b", None), ("curl -X 'DELETE' https://a.b", "method"), ("curl https://a.b -- -X DELETE", None), ("curl -d -X https://a.b", None),
    ("curl -F 'f=@/tmp/q' https://a.b/up/1", None), ("curl -F 'f=@/etc/q' https://a.b/up", "form"), ("curl -F f=@/tmp/q https://a.b/c", "form"),
    ("git add a b", None), ("git add", "paths"), ("git add .", "paths"), ("git add x -A", "paths"),
    ("git push o x", None), ("git push o", "push"), ("git push -u o x", None), ("git push o +x:main", "branch"), ("git push o +main", "branch"),
    ("docker logs x", "logs"), ("docker logs --tail=5 x", None), ("docker logs -n 5 x", None),
    ("git rebase o/m", None), ("git rebase o/n", "rebase"), ("git -C /x rebase o/n", "rebase"), ("git -C /a --directory /b rebase o/m", None),
    ("docker volume rm x", "remove"), ("docker volume ls", None),
    ("mvn -q -pl core test", None), ("mvn -pl test", "command not allowed"), ("mvn -f", "command not allowed"),
    ('git log --grep "a|b;c"', None), (r"git log a\;b", None), ("git log 'a > b'", None), ("git log | jq .", None), ("git log && jq .", "composed command"),
    ("git log | jq . &", "composed command"), ("git log > f", "composed command"), ("git log 2>&1", "composed command"),
    ('git log "$(rm x)"', "composed command"), ("git log '$(rm x)'", None), ("git log \"it's\" `x`", "composed command"), ("(git log)", "composed command"),
    ('git log "a', None), ("bd show 5", None), ("bd close 5", "command not allowed"), ("bd -C /x dep list", None), ("", None), ("  ", None),
    ("git log " + "a" * 100_000 + ' "' + "b c" * 50_000 + '"', None),
]


def test_guards(spark):
    calls = spark.createDataFrame([(k, "w", "Bash", c, None, False) for k, (c, _) in enumerate(GUARDED)], "call_id long, agent_type string, tool_name string, command string, target string, bypass boolean")
    got = {r.call_id: r.denied for r in policy.audit(calls, policy.read_rules(spark, GUARDS)).collect()}
    assert {c[:80]: got[k] for k, (c, _) in enumerate(GUARDED)} == {c[:80]: want for c, want in GUARDED}


def test_guards_of_profiles(spark):
    """Overridden guards hold for others; a line without limits is checked command by command."""
    lines = [("loose", "jq . a > b 2>&1; docker rm x", "remove"), ("loose", "jq . a >> b && jq . c", None), ("loose", "jq $(rm x)", "composed command"), ("loose", "git log", "waived"), ("w", "git log", None), ("main", "bd list", None), ("main", "bd list; bd list", "tool not allowed"), ("main", None, "tool not allowed")]
    calls = spark.createDataFrame([(k, p, "Bash", c, None, False) for k, (p, c, _) in enumerate(lines)], "call_id long, agent_type string, tool_name string, command string, target string, bypass boolean")
    got = {r.call_id: r.denied for r in policy.audit(calls, policy.read_rules(spark, GUARDS)).collect()}
    assert [got[k] for k in range(len(lines))] == [want for *_, want in lines]
    with pytest.raises(ValueError, match="guard push: unknown kind deny-some"):
        policy.read_rules(spark, GUARDS.replace("require-explicit-push-target", "deny-some"))


def test_suggestions(spark):
    lines = [("/usr/bin/rg x",), ("cd /a && cat b",), ("git status",), ("",), (None,)]
    got = [r.s for r in spark.createDataFrame(lines, "c string").select(policy.suggestion(F.col("c")).alias("s")).collect()]
    assert got == ["Use the native Grep tool instead.", "Use the native Read tool for file inspection.", None, None, None]


def test_diff_of_users_tables(spark):
    a = spark.createDataFrame([("c1", "2026-01-01T00:00:00Z", "x", None), ("c2", "t", "y", "{}")], USER_TABLES["config_versions"])
    b = spark.createDataFrame([("c1", "2026-01-01T00:00:00+00:00", "z", None)], USER_TABLES["config_versions"])
    assert {tuple(r) for r in diff.config_versions_diff(a, b).collect()} == {("c1", "differs", "description", "x", "z"), ("c2", "only_a", None, None, None)}
    a = spark.createDataFrame([("s", "good", None, "t"), ("s", "good", None, "t")], USER_TABLES["annotations"])
    b = spark.createDataFrame([("s", "good", "n", "t"), ("r", "bad", None, "t")], USER_TABLES["annotations"])
    assert {tuple(r) for r in diff.annotations_diff(a, b).collect()} == {("s|good|t", "differs", "notes", None, "n"), ("r|bad|t", "only_b", None, None, None)}


def test_rendering(spark):
    df = spark.createDataFrame([("a|b", 1.0, None), ("ü", 2.5, True)], "x string, y double, z boolean")
    assert render(df) == "x    y    z\n---  ---  ----\na|b  1\nü    2.5  true"
    assert render(df, "csv").startswith("x,y,z\r\n") and '"x": "ü"' in render(df, "json") and "a\\|b" in render(df, "markdown")
    assert render(df.where("false")) == "(no results)" and render(df.where("false"), "json") == "[]"


def test_scratch_folder(spark):
    assert scratch_dir(spark).startswith("file://" + spark.conf.get("spark.checkpoint.dir") + "/")
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().logical().toString()


def _busy(spark, n=900, seed=5):
    """One session with most rows, over files and hours of very unequal size, with equal times."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hour = r.choice([1, 1, 1, 1, 2, 5, 5, 9, 23])
        day = r.choice([1, 1, 2])
        kind = r.choice(["PreToolUse", "PostToolUse", "Stop", "PostToolUseFailure"])
        rows.append((f"f{day}", f"2026-02-0{day}T{hour:02}:{r.randint(0, 3):02}:00Z", i, r.choice(["hot", "hot", "hot", f"s{i % 40}"]), kind, r.choice([None, "Read", "Bash"]), r.choice([None, "a", "a", "b", f"t{i}"])))
    return spark.createDataFrame(rows, "source_file string, timestamp string, raw_index long, session_id string, event_type string, tool_name string, tool_use_id string").repartition(6)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_rows_before_by_parts(spark, k):
    events = _busy(spark)
    order = ("source_file", "timestamp", "raw_index")
    w = W.partitionBy("session_id").orderBy(*order)
    plain = events.select("raw_index", F.collect_list(F.struct(F.col("tool_name").alias("v"))).over(w.rowsBetween(-k, -1)).alias("before"))
    got = enrich.lagged(events, F.col("tool_name"), k)
    assert got.columns == [*events.columns, "before"]
    assert {r.raw_index: r.before for r in got.collect()} == {r.raw_index: r.before for r in plain.collect()}
    some = enrich.lagged(events, F.col("tool_name"), k, wanted=F.col("event_type") == "Stop")
    stops = plain.join(events.where("event_type = 'Stop'").select("raw_index"), "raw_index")
    assert {r.raw_index: r.before for r in some.collect()} == {r.raw_index: r.before for r in stops.collect()}


def test_latest_value_by_parts(spark):
    events = _busy(spark).where("tool_use_id IS NOT NULL")
    group, value = ("source_file", "session_id", "tool_use_id"), F.when(F.col("event_type") == "PreToolUse", F.struct("timestamp", "tool_name"))
    w = W.partitionBy(*group).orderBy(*enrich.ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    plain = events.select("raw_index", F.last(value, ignorenulls=True).over(w).alias("latest"))
    got = enrich.latest(events, value, group)
    assert got.columns == [*events.columns, "latest"]
    assert {r.raw_index: r.latest for r in got.collect()} == {r.raw_index: r.latest for r in plain.collect()}


def test_no_window_holds_a_session(spark):
    """A session of one busy hour of ten is dealt to tasks by its hours."""
    hours = spark.range(4000).select(F.lit("f").alias("source_file"), F.format_string("2026-02-01T%02d:00:00Z", F.col("id") % 10).alias("timestamp"), F.col("id").alias("raw_index"), F.lit("one").alias("session_id"), F.lit("x").alias("event_type"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = enrich.lagged(hours, F.col("event_type"), 5).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 4000
    assert enrich.lagged(hours.where("false"), F.col("event_type"), 5).count() == 0


def test_postings_shuffle_nothing_and_hold_every_word(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 3)
    texts = [(1, "b a b", "a"), (2, None, "Ä b"), (3, "", None), (4, "...", "c " * 9), (5, None, None)]
    docs = spark.createDataFrame(texts, "id long, t string, u string")
    made = search.postings(docs, "id", ["t", "u"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    plain = {(r.id, r.field, r.term, r.pos) for r in search.build(docs, "id", ["t", "u"]).collect()}
    assert sorted((r.id, r.field, r.term, p) for r in made.collect() for p in r["at"]) == sorted(plain)
    assert {(r.id, r.len) for r in made.collect()} == {(1, 4), (2, 2), (4, 9)} and all(r["at"] == sorted(r["at"]) for r in made.collect())
    assert tuple(search.totals(made).first()) == (3, 15)
    assert tuple(search.totals(made.where("false")).first()) == (0, 0)


def test_written_indexes_grow_and_are_replaced(spark):
    folder = f"{scratch_dir(spark)}/index"
    docs = lambda *ids: spark.createDataFrame([(i, f"common w{i} w{i}") for i in ids], "id long, t string")
    hits = lambda *words: sorted(r.id for r in search.any_of(*[search.term(search.read(spark, folder, list(words), "long"), w) for w in words]).collect())
    for ids in ((1, 2), (3,), ()):
        search.write(docs(*ids) if ids else docs(1).where("false"), "id", ["t"], folder)
    assert hits("common") == [1, 2, 3] and hits("w3", "w1") == [1, 3]
    assert tuple(search.size_of(spark, folder).first()) == (3, 3.0)
    search.write(docs(4), "id", ["t"], folder, append=False)
    assert hits("common") == [4] and hits("w1") == [] and tuple(search.size_of(spark, folder).first()) == (1, 3.0)
