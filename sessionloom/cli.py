"""``python -m sessionloom.cli --store FOLDER COMMAND …``: the commands over a store."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame

from sessionloom.operators import commands as C
from sessionloom.operators import live
from sessionloom.render import render
from sessionloom.runtime import build_session
from sessionloom.sources import jsonl, legacy_sqlite
from sessionloom.store import TABLES, Store
from sessionloom.streaming import jobs


def questions(store: Store, now: str) -> dict:
    """name -> function of the parsed arguments."""
    t = store.table
    recent = lambda a: jsonl.events(jsonl.envelopes(jsonl.scan(store.spark, jsonl.last_days(jsonl.log_files(store.spark, a.logs), now, a.days))))
    return {
        "summary": lambda a: C.summary(t("sessions"), now, a.days),
        "sessions": lambda a: C.session_list(t("sessions"), now, a.days, a.cwd, a.branch, a.label, t("annotations")),
        "session": lambda a: C.session_timeline(t("events"), t("sessions"), a.args[0]),
        "last": lambda a: C.last_session(t("events"), t("sessions")),
        "chain": lambda a: C.chain(t("sessions"), a.args[0]),
        "tools": lambda a: C.tools(t("tool_calls")) if a.all_time else C.tools_current(t("tool_calls"), t("sessions")),
        "agents": lambda a: C.agents(t("tool_calls")),
        "skills": lambda a: C.skills(t("events"), *a.args[:1]),
        "failures": lambda a: C.failures(t("events"), now, a.days),
        "before-stop": lambda a: C.before_stop(t("events")),
        "compactions": lambda a: C.compactions(t("events")),
        "configs": lambda a: C.configs(t("sessions"), t("config_versions")),
        "diff": lambda a: C.session_diff(t("events"), t("sessions"), *a.args[:2]),
        "trends": lambda a: C.trends(t("sessions"), a.args[0], now, a.days),
        "slow": lambda a: C.slow(t("tool_calls"), a.threshold, *a.args[:1]),
        "tokens": lambda a: C.tokens(t("sessions"), *a.args[:1]),
        "append-daily": lambda a: C.daily_totals(t("sessions"), now),
        "search": lambda a: store.search(a.args),
        "sql": lambda a: store.sql(a.args[0], a.write),
        "coverage": lambda a: live.coverage(recent(a), a.args[0]),
        "provenance": lambda a: live.provenance_sessions(recent(a)),
        "gate": lambda a: live.gate(recent(a)),
        "replay": lambda a: jsonl.replay(jsonl.scan(store.spark, a.args[:1])),
        "prune": lambda a: store.prune(a.args[0]),
    }


def tail(stream: DataFrame, only: str | None = None) -> None:
    """Prints new lines until interrupted."""

    def show(df: DataFrame, _: int) -> None:
        for r in jsonl.tail_lines(df, only).orderBy("raw_index").toLocalIterator():
            print(r.shown, flush=True)

    query = stream.writeStream.foreachBatch(show).trigger(processingTime="500 milliseconds").start()
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
        raise SystemExit(130) from None


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sessionloom")
    p.add_argument("--store", required=True)
    p.add_argument("--logs")
    p.add_argument("--now", default=dt.date.today().isoformat())
    p.add_argument("--format", choices=["table", "json", "csv", "markdown"], default="table")
    p.add_argument("--days", type=int, default=7)
    p.add_argument("--threshold", type=int, default=5000)
    p.add_argument("--max-age", type=float, help="seconds; older tables take in the logs before the answer")
    for flag in ("--cwd", "--branch", "--label", "--since", "--out"):
        p.add_argument(flag)
    for flag in ("--all-time", "--include-today", "--write"):
        p.add_argument(flag, action="store_true")
    p.add_argument("command")
    p.add_argument("args", nargs="*")
    a = p.parse_args(argv)
    spark = build_session()
    store = Store(spark, a.store)
    waiting = lambda: jsonl.unprocessed(jsonl.log_files(spark, a.logs), a.now, a.include_today)
    if a.max_age is not None and a.logs and a.command in questions(store, a.now):
        store.ingest_if_older(waiting, a.max_age)
    if a.command == "ingest":
        print(store.ingest(a.args or waiting()))
    elif a.command == "import-legacy":
        if not a.args:
            p.error("import-legacy: files, an old database, or a home folder to look through")
        one = a.args[0]
        files = a.args if one.endswith((".jsonl", ".gz")) else jsonl.legacy_files(spark, one)
        old = legacy_sqlite.read_events(spark, one) if one.endswith(".db") else jsonl.scan(spark, files)
        print(store.ingest_lines(jsonl.normalize_legacy(old, a.now)))
    elif a.command == "tail":
        tail(jobs.tail(spark, a.args[0]), *a.args[1:2])
    elif a.command == "health":
        print(f"store: {store.check()}", render(C.table_counts({n: store.table(n) for n in TABLES}), a.format), render(C.chain_stats(store.table("sessions")), a.format), *([render(jsonl.inventory(spark, a.logs, a.now), a.format)] if a.logs else []), sep="\n")
    elif a.command == "rebuild":
        print(store.rebuild(since=a.since))
    elif a.command == "init":
        store.init()
        print(f"store: {store.check()}")
    elif a.command == "export":
        made = C.export(store.table("sessions"), *a.args[:2])
        if a.out:
            made.write.text(a.out)  # the part files' order is that of the sessions
        else:
            for r in made.toLocalIterator():
                print(r.value)
    elif a.command == "backup":
        store.backup(a.args[0])
    elif a.command == "label":
        store.label(" ".join(a.args), a.now)
    elif a.command == "annotate":
        print(store.annotate(a.args[0], a.args[1], " ".join(a.args[2:]) or None, a.now))
    else:
        print(render(questions(store, a.now)[a.command](a), a.format))


if __name__ == "__main__":
    main()
