"""Audit of tool calls against an allow policy, as joins with small rule tables.

A rule set has ``aliases`` (agent, profile), ``tools`` (profile, tool; a trailing *
allows a prefix), ``spawns`` (profile, target, and may_bypass where some targets may
run without permissions) and ``prefixes`` (profile, words: the leading words of
allowed shell commands). It may have ``guards`` (what a profile's allowed commands
must not do, see GUARD) and ``structure`` (profile, single, pipes, plain: one
command only, pipelines all the same, no redirections); without the latter every
profile is held to one plain command.

Commands are split at shell operators and blanks outside quotes and escapes; words
keep their quotes, redirections go. Substitutions and subshells are not looked into
and denied for every profile; the lines of a here-document count as commands."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Shells and wrappers, tool names, and what to use instead of a denied command.
WRAPPERS = ("bash", "sh", "zsh", "sudo", "env", "command")
SHELL, SPAWN = "Bash", "Task"
DEFAULT = "_default"
TOOLS = (
    "Agent", "AskUserQuestion", "Bash", "Edit", "EnterPlanMode", "ExitPlanMode", "Glob", "Grep", "Read", "Search", "Skill", "Task",
    "TaskCreate", "TaskGet", "TaskList", "TaskOutput", "TaskUpdate", "TodoRead", "TodoWrite", "WebFetch", "Write", "ast_grep_search",
    "lsp_diagnostics", "lsp_document_symbols", "lsp_find_references", "lsp_goto_definition", "lsp_hover", "lsp_servers", "lsp_workspace_symbols",
)
INSTEAD = {
    "Use the native Grep tool instead.": ("grep", "egrep", "fgrep", "rg"),
    "Use the native Glob tool instead.": ("find", "fd"),
    "Use the native Read tool for file inspection.": ("cat", "head", "tail", "sed", "awk"),
    "Use Read, Glob, and task context for path inspection; for symlinks, resolve the real target with allowed native tools or report the blocker.": ("ls", "stat", "file", "readlink", "greadlink", "realpath"),
    "Do not use scripting languages as shell substitutes; use native tools or report the blocked command.": ("python", "python3", "node", "ruby", "perl"),
    "Use Edit/Write for file changes; if runtime/editor verification is needed, report the blocked command so the orchestrator can route or update policy.": ("nvim", "vim", "vi", "emacs"),
    "Ask the orchestrator to delegate build/test verification to build-runner.": ("npm", "pnpm", "mvn", "mvnw", "gradle", "cargo", "go", "jest", "vitest"),
}
# Commands that every profile may run, one at a time.
EVERYWHERE = (
    "bd --help", "bd -h", "bd help", "bd prime", "bd ready", "bd show", "bd list", "bd status", "bd stats", "bd search", "bd blocked",
    "bd graph", "bd count", "bd children", "bd history", "bd types", "bd statuses", "bd context", "bd where", "bd info", "bd recall",
    "bd state", "bd quickstart", "bd human", "bd version", "bd preflight", "bd lint", "bd stale", "bd defer", "bd diff", "bd memories",
    "bd dep list", "bd dep tree", "bd dep cycles",
)
# Kinds of guards, and the options of curl and Maven that take a value.
KINDS = (
    "deny-flags", "require-positional-prefix", "require-curl-url-prefix", "allow-curl-headers", "allow-curl-methods", "allow-curl-forms",
    "require-explicit-pathspecs", "require-explicit-push-target", "deny-protected-branch", "require-bounded-logs", "deny-always", "deny-subcommands",
)
CURL_VALUES = (
    "-[AbcdeEFHKoTuxX]|--(user-agent|cookie|cookie-jar|data|data-raw|data-binary|data-urlencode|referer|cert|key|form|form-string"
    "|header|config|output|upload-file|user|proxy|request|url)(=|$)"
)
MAVEN_VALUES = "(-f|--file|-s|--settings|-gs|--global-settings|-t|--toolchains|-P|--activate-profiles|-pl|--projects|-rf|--resume-from)$"

GUARD = (
    "profile string, guard string, kind string, prefix array<string>, message string, allow_exact array<array<string>>, flags array<string>, "
    "prefixes array<string>, targets array<string>, forbid array<string>, branches array<string>, subcommands array<array<string>>"
)


@dataclass
class Rules:
    aliases: DataFrame
    tools: DataFrame
    spawns: DataFrame
    prefixes: DataFrame
    guards: DataFrame | None = None
    structure: DataFrame | None = None


def rule_errors(rules: dict) -> list[str]:
    """What is wrong with a rule file's contents; nothing if it can be used."""
    profiles, categories, guards = (rules.get(k, {}) for k in ("profiles", "command-categories", "safety"))
    found = [] if DEFAULT in profiles else [f"no profile {DEFAULT}"]
    found += [f"guard {name}: unknown kind {g.get('kind')}" for name, g in guards.items() if g.get("kind") not in KINDS]
    owner: dict[str, str] = {}
    for profile, p in profiles.items():
        own = p.get("commands", {}).get("categories", [])
        for what, names, there in (
            ("tool", p.get("tools", []), TOOLS),
            ("command category", own, categories),
            ("safety override", p.get("safety-overrides", []), guards),
            ("spawn target", [t["profile"] for t in p.get("agent", {}).get("spawn", {}).get("allow", [])], profiles),
        ):
            found += [f"profile {profile}: unknown {what} {n}" for n in names if n not in there]
        found += [f"profile {profile}: the name {n} is taken by {owner[n]}" for n in _names(profile, p) if owner.setdefault(n, profile) != profile]
        allowed = [words for c in own for words in categories.get(c, {}).get("allow", [])]
        for guard in p.get("safety-overrides", []):
            start = guards.get(guard, {}).get("command", {}).get("prefix")
            if start is not None and not any(words[: len(start)] == start for words in allowed):
                found.append(f"profile {profile}: safety override {guard} is for no command that the profile allows")
    return found


def _names(profile: str, p: dict) -> list[str]:
    return [n.strip().lower() for n in (profile, *p.get("aliases", []))]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that travels in the plan, so that its size is known there."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], to_arrow_schema(fields)), fields)


def read_rules(spark: SparkSession, text: str) -> Rules:
    """The rule tables of a TOML file's text: profiles with their other names,
    tools, command categories, spawn targets (under any name of the target), the
    guards that a profile does not override, and its limits on a line's structure.
    Raises ValueError with all that is wrong with it."""
    rules = tomllib.loads(text)
    if wrong := rule_errors(rules):
        raise ValueError("; ".join(wrong))
    profiles, categories = rules["profiles"], rules.get("command-categories", {})
    each = profiles.items()
    spawns = [(k, n, t.get("may-bypass", False)) for k, p in each for t in p.get("agent", {}).get("spawn", {}).get("allow", []) for n in _names(t["profile"], profiles[t["profile"]])]
    lists = ("allow-exact", "flags", "prefixes", "targets", "forbid", "branches", "subcommands")
    guards = [
        (k, name, g["kind"], g["command"]["prefix"], g["message"], *(g.get(f, []) for f in lists))
        for k, p in each
        for name, g in rules.get("safety", {}).items()
        if name not in p.get("safety-overrides", [])
    ]
    limits = [(k, p.get("commands", {}).get("structure", {})) for k, p in each]

    def make(rows: list[tuple], schema: str) -> DataFrame:
        return table(spark, rows, schema)

    return Rules(
        make([(n, k) for k, p in each for n in _names(k, p)], "agent string, profile string"),
        make([(k, t) for k, p in each for t in (*p.get("tools", []), *p.get("mcp-tools", []))], "profile string, tool string"),
        make(spawns, "profile string, target string, may_bypass boolean"),
        make([(k, " ".join(words)) for k, p in each for c in p.get("commands", {}).get("categories", []) for words in categories[c]["allow"]], "profile string, words string"),
        make(guards, GUARD),
        make([(k, *(x.get(f, False) for f in ("single-command", "allow-pipeline", "no-redirection"))) for k, x in limits], "profile string, single boolean, pipes boolean, plain boolean"),
    )


def suggestion(command: Column) -> Column:
    """What to use instead of a shell line's first command; null if nothing is known."""
    name = F.get(F.get(simple_commands(command), 0), 0)
    return F.coalesce(*[F.when(name.isin(*names), text) for text, names in INSTEAD.items()])


_WORD = r"""(?:[^\s"'\\;&|<>]++|"(?:[^"\\]++|\\.)*+"|'[^']*+'|\\.|["'\\])++"""
_TOKEN = rf"(?s)\d*+(?:&>>?|[<>]++&?)[ \t]*+(?:{_WORD})?|&&|\|\||[;|&\n]|{_WORD}"
_BETWEEN = ("&&", "||", ";", "|", "&", "\n")


def _tokens(command: Column) -> Column:
    bare = F.regexp_replace(F.trim(command), r"^(?:(?:cd|source|export)\s+[^&;|]+&&\s*)+", "")
    return F.filter(F.regexp_extract_all(bare, F.lit(_TOKEN), 0), lambda t: ~t.rlike(r"^(\d*[<>]|&>)"))


def simple_commands(command: Column) -> Column:
    """The simple commands of a shell line, each an array of words; a leading
    ``cd … &&`` goes, as do the options that normalized() drops."""
    return _commands(_tokens(command))


def _commands(tokens: Column) -> Column:
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*_BETWEEN), i)), lambda i: i.isNotNull())
    parts = F.zip_with(F.concat(F.array(F.lit(-1)), ends), F.concat(ends, F.array(F.size(tokens))), lambda a, b: F.slice(tokens, a + 2, b - a - 1))
    return F.transform(F.filter(parts, lambda w: F.size(w) > 0), normalized)


def normalized(words: Column) -> Column:
    """A command with its name cut to the last path part, without the folders
    that git and bd are sent to and without Maven's options before the goal."""
    n = F.size(words)
    name = F.element_at(F.split(words[0], "/"), -1)
    kept = F.get(F.filter(F.transform(words, lambda w, i: F.when((i % 2 == 1) & (~w.isin("-C", "--directory") | (i + 1 >= n)), i)), lambda i: i.isNotNull()), 0)
    goal = F.aggregate(
        F.transform(_rest(words), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))),
        F.struct(F.lit(False).alias("skip"), F.lit(None).cast("int").alias("at")),
        lambda s, x: F.when(s.at.isNotNull(), s)
        .when(s.skip, F.struct(F.lit(False).alias("skip"), s.at.alias("at")))
        .when(x.w.startswith("-"), F.struct(x.w.rlike("^" + MAVEN_VALUES).alias("skip"), s.at.alias("at")))
        .otherwise(F.struct(F.lit(False).alias("skip"), x.i.alias("at"))),
    ).at
    first = F.coalesce(F.when(name.isin("git", "bd"), kept).when(name.isin("mvn", "mvnw"), goal).otherwise(F.lit(1)), n)
    return F.concat(F.array(name), F.slice(words, first + 1, F.greatest(n - first, F.lit(0))))


def _rest(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


_SINGLE, _DOUBLE = r"'[^']*+'", r'"(?:[^"\\]++|\\.)*+"'


def _outside_quotes(command: Column) -> Column:
    return F.regexp_replace(command, rf"(?s)\\.|{_SINGLE}|{_DOUBLE}", "")


def substituted(command: Column) -> Column:
    """A command substitution outside single quotes, or a subshell."""
    inner = F.regexp_replace(command, rf"(?s)({_DOUBLE})|\\.|{_SINGLE}", "$1")
    return command.rlike("[`(]") & (inner.rlike(r"(?<!\\)(`|\$\()") | _outside_quotes(command).rlike(r"(^|[\s;&|<>])\("))


def redirected(command: Column) -> Column:
    """A redirection outside quotes."""
    return command.rlike("[<>]") & _outside_quotes(command).rlike("[<>]")


def composed(command: Column) -> Column:
    """More than one simple command, a job in the background, a redirection or a substitution."""
    ends = F.exists(_tokens(command), lambda t: t == "&")
    return (F.size(simple_commands(command)) > 1) | F.coalesce(ends | redirected(command) | substituted(command), F.lit(False))


def starts_with(words: Column, prefix: Column) -> Column:
    return F.slice(words, 1, F.size(prefix)) == prefix


def _starts_any(value: Column, starts: Column) -> Column:
    return F.exists(starts, lambda s: value.startswith(s))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _walk(args: Column, step) -> Column:
    """Arguments of curl from left to right: what ``step`` gives for those that are
    not an option's value, as a state ``mode`` (go on, skip or take the next one,
    end) and the values ``got``."""

    def state(mode: str, got: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), got.alias("got"))

    return F.aggregate(
        args,
        state("go", F.array().cast("array<string>")),
        lambda s, a: F.when(s.mode == "end", s)
        .when(s.mode == "skip", state("go", s.got))
        .otherwise(step(s, a, state)),
    ).got


def curl_url(args: Column) -> Column:
    """The address that curl is given: of ``--url`` or the first argument that is
    neither an option nor an option's value; null without one."""

    def step(s: Column, a: Column, state) -> Column:
        return (
            F.when(s.mode == "take", state("end", F.array(a)))
            .when(a.isin("--", "--url"), state("take", s.got))
            .when(a.startswith("--url="), state("end", F.array(F.substr(a, F.lit(7)))))
            .when(a.rlike(f"^({CURL_VALUES})"), state("skip", s.got))
            .when(a.startswith("-"), state("go", s.got))
            .otherwise(state("end", F.array(a)))
        )

    return F.get(_walk(args, step), 0)


def curl_values(args: Column, short: str, long: str) -> Column:
    """The values of an option of curl, in any of its spellings, up to ``--``."""

    def step(s: Column, a: Column, state) -> Column:
        return (
            F.when(s.mode == "take", state("go", F.array_append(s.got, a)))
            .when(a == "--", state("end", s.got))
            .when(a.isin(short, long), state("take", s.got))
            .when(a.startswith(short) | a.startswith(long + "="), state("go", F.array_append(s.got, F.regexp_replace(a, f"^({short}=?|{long}=)", ""))))
            .when(a.rlike(f"^({CURL_VALUES})"), state("skip", s.got))
            .otherwise(state("go", s.got))
        )

    return F.transform(_walk(args, step), _unquoted)


def breaks(words: Column, guard: Column) -> Column:
    """Whether a command (an array of words) is one that a guard (a row of GUARD)
    looks at and does what that forbids. A kind that is not known never does."""
    args = _rest(words)
    positional = F.filter(args, lambda a: ~a.startswith("-"))
    first, url = F.get(positional, 0), _unquoted(curl_url(args))
    branches = F.flatten(F.transform(F.slice(positional, 3, F.size(args)), lambda a: F.split(a, ":")))
    forms = curl_values(args, "-F", "--form")

    def flagged(a: Column, f: Column) -> Column:
        letters = a.rlike("^-[^-]") & f.rlike("^-.$") & F.contains(F.substr(a, F.lit(2)), F.substr(f, F.lit(2)))
        return (a == f) | a.startswith(F.concat(f, F.lit("="))) | letters

    does = (
        F.when(guard.kind == "deny-flags", F.exists(args, lambda a: F.exists(guard.flags, lambda f: flagged(a, f))))
        .when(guard.kind == "require-positional-prefix", ~F.coalesce(_starts_any(first, guard.prefixes), F.lit(False)))
        .when(guard.kind == "require-curl-url-prefix", ~F.coalesce(_starts_any(url, guard.prefixes), F.lit(False)))
        .when(guard.kind == "allow-curl-headers", F.exists(curl_values(args, "-H", "--header"), lambda h: ~_starts_any(h, guard.prefixes)))
        .when(guard.kind == "allow-curl-methods", F.exists(curl_values(args, "-X", "--request"), lambda m: ~F.array_contains(guard.prefixes, F.upper(m))))
        .when(guard.kind == "allow-curl-forms", (F.size(forms) > 0) & (~F.coalesce(_starts_any(url, guard.targets), F.lit(False)) | F.exists(forms, lambda f: ~_starts_any(f, guard.prefixes))))
        .when(guard.kind == "require-explicit-pathspecs", (F.size(args) <= 1) | F.arrays_overlap(_rest(args), guard.forbid))
        .when(guard.kind == "require-explicit-push-target", F.size(positional) < 3)
        .when(guard.kind == "deny-protected-branch", F.exists(branches, lambda b: F.array_contains(guard.branches, F.regexp_replace(b, r"^\++", ""))))
        .when(guard.kind == "require-bounded-logs", ~F.exists(args, lambda a: a.isin("--tail", "-n") | a.startswith("--tail=")))
        .when(guard.kind == "deny-always", F.lit(True))
        .when(guard.kind == "deny-subcommands", F.exists(guard.subcommands, lambda p: starts_with(args, p)))
        .otherwise(F.lit(False))
    )
    return starts_with(words, guard.prefix) & ~F.array_contains(guard.allow_exact, words) & does


def policies(rules: Rules) -> DataFrame:
    """All that holds for an agent in one row: agent, profile and the profile's
    rules as arrays. The rule tables are stacked and grouped once, so their size is
    known before the calls are joined."""
    tools, spawns = rules.tools, rules.spawns
    parts = [
        rules.aliases.select("profile", "agent"),
        tools.select("profile", F.when(tools.tool.endswith("*"), F.expr("substr(tool, 1, length(tool) - 1)")).alias("start"), F.when(~tools.tool.endswith("*"), tools.tool).alias("tool")),
        spawns.select("profile", "target", F.expr("CASE WHEN may_bypass THEN target END" if "may_bypass" in spawns.columns else "CAST(NULL AS STRING)").alias("free")),
        rules.prefixes.select("profile", F.split("words", " ").alias("prefix")),
    ]
    guards = rules.guards if rules.guards is not None else rules.aliases.sparkSession.createDataFrame([], GUARD)
    fields = [c for c in guards.columns if c not in ("guard", "profile")]
    parts.append(guards.select("profile", F.struct("guard", *fields).alias("guard")))
    if rules.structure is not None:
        parts.append(rules.structure.select("profile", "single", "pipes", "plain"))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    limits = {"single": True, "pipes": False, "plain": True}
    held = [(F.coalesce(F.max(c), F.lit(False)) if rules.structure is not None else F.lit(v)).alias(c) for c, v in limits.items()]
    lists = [F.collect_set(c).alias(f"_{n}") for c, n in (("start", "starts"), ("tool", "tools"), ("target", "targets"), ("free", "free"), ("prefix", "prefixes"))]
    by_profile = stacked.groupBy("profile").agg(F.collect_set("agent").alias("_agents"), *lists, F.array_sort(F.collect_list("guard")).alias("_guards"), *held)
    return by_profile.select("*", F.explode("_agents").alias("agent")).drop("_agents")


def audit(calls: DataFrame, rules: Rules) -> DataFrame:
    """Calls (call_id, agent_type, tool_name, command, target, bypass) with
    ``denied``: the first reason that holds (the guard's message, where it is one),
    or null. One join with policies(); whether that is broadcast is left to its size."""
    command, tool = F.col("command"), F.col("tool_name")
    joined = calls.withColumn("agent", F.lower(F.trim(F.coalesce("agent_type", F.lit(""))))).join(policies(rules), "agent", "left")
    is_shell = (tool == SHELL) & command.isNotNull()
    joined = joined.withColumn("_tokens", F.when(is_shell, _tokens(command)))
    joined = joined.withColumn("_commands", _commands(F.col("_tokens")))
    joined = joined.withColumn("_redirected", is_shell & redirected(command)).withColumn("_substituted", is_shell & substituted(command))
    commands, between = F.col("_commands"), F.filter("_tokens", lambda t: t.isin(*_BETWEEN))
    parted = (F.size(commands) > 1) | F.array_contains(between, "&")
    first, ours = F.get(commands, 0), F.array(*[F.split(F.lit(p), " ") for p in EVERYWHERE])
    known = F.get(first, 0).isin(*{p.split(" ")[0] for p in EVERYWHERE}) & F.exists(ours, lambda p: starts_with(first, p))
    everywhere = is_shell & F.coalesce(known & ~parted & ~F.col("_redirected") & ~F.col("_substituted"), F.lit(False))
    allowed = F.forall(commands, lambda c: F.exists("_prefixes", lambda p: starts_with(c, p))) | everywhere
    wrapped = F.exists(commands, lambda c: c[0].isin(*WRAPPERS))
    much = (F.col("single") & parted & ~(F.col("pipes") & F.forall(between, lambda t: t == "|"))) | (F.col("plain") & F.col("_redirected")) | F.col("_substituted")
    stopped = F.get(F.flatten(F.transform(commands, lambda c: F.transform(F.filter("_guards", lambda g: breaks(c, g)), lambda g: g.message))), 0)
    tool_ok = F.array_contains("_tools", tool) | F.exists("_starts", lambda s: tool.startswith(s)) | everywhere
    spawn, free = tool == SPAWN, F.array_contains("_free", F.col("target"))
    reason = (
        F.when(F.col("profile").isNull(), "unknown agent")
        .when(~F.coalesce(tool_ok, F.lit(False)), "tool not allowed")
        .when(spawn & F.coalesce("bypass", F.lit(False)) & ~F.coalesce(free, F.lit(False)), "bypassed permissions")
        .when(spawn & ~F.coalesce(F.array_contains("_targets", F.col("target")), F.lit(False)), "target not allowed")
        .when(wrapped, "wrapper command")
        .when(is_shell & much, "composed command")
        .when(is_shell & ~allowed, "command not allowed")
        .when(is_shell, stopped)
    )
    return joined.select("call_id", "profile", reason.alias("denied"))
