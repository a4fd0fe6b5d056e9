"""Tables as folders of Parquet parts.

A numbered pointer file names the parts of every table; the highest number
counts. A new one is written beside it and renamed into place, and older ones
are only deleted once they are two behind. Whatever an ingest changes is written
first and becomes visible by one new pointer, so readers see whole versions and a
failed job leaves the old one. One writer at a time, by convention of the job that
owns the folder.

Lines and events are cut into parts by the file they come from, sessions, tool
calls and the rows that they are folded from by a hash of the session. Ingesting a
file adds its lines and events and writes the session parts anew that it touches,
or whose lineage it changes; other parts are neither read nor written, but for the
hashes of events and the columns that lineage goes by.

A file is known by its whole path, so logs of several hosts stay apart. One that
comes again with all its old lines takes their place; if some of those are gone
(the name was used for another log), it is kept beside them as ``path#2`` and so on.

Pruning remembers what it took: a cutoff for each file that was there, and the
session rows. Rebuilding works from whole files, and takes the same away again."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import commands as C
from sessionloom.operators import enrich as N
from sessionloom.operators import search
from sessionloom.runtime import materialize
from sessionloom.sources import jsonl

# Schema version, columns of the users' tables and statements that change data.
SCHEMA_VERSION = "v5"
USER_TABLES = {
    "config_versions": "version_hash string, captured_at string, description string, files_snapshot string",
    "annotations": "session_id string, label string, notes string, created_at string",
}
# what was pruned
PRUNED = {"pruned_files": "source_file string, cutoff string", "pruned_rows": "source_file string, session_id string"}
TABLES = ("lines", "events", "session_rows", "tool_call_rows", "sessions", "tool_calls", "postings", "index_size", *USER_TABLES)
BY_FILE = ("lines", "events")
BY_SESSION = ("session_rows", "tool_call_rows", "sessions", "tool_calls")
INDEX = ("postings", "index_size")  # of the texts of events
DERIVED = ("events", *BY_SESSION, *INDEX)
TEXTS = ["prompt_text", "error", "tool_input"]
CROWDED = 16  # parts of one hash of terms, before they become one
KEY = "_part"
MUTATIONS = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "REPLACE")


def config_hash(contents: list[bytes]) -> str:
    """Eight hex digits that name a configuration: its files' contents, in order."""
    return hashlib.sha256(b"".join(contents)).hexdigest()[:8]


POINTER = re.compile(r"/CURRENT-(\d+)\.json$")


def file_key(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:16]


def part_key(part: str) -> str:
    return part.partition(f"/{KEY}=")[2]


def generation(name: str, n: int) -> str:
    """What the n-th log that came under a name is kept by."""
    return name if n == 1 else f"{name}#{n}"


def known(events: DataFrame, lines: DataFrame) -> DataFrame:
    """What was known at ingest, put over the payload's fields."""
    sources = lines.groupBy("source_file").agg(F.max("config_version").alias("_version"), F.max("git").alias("_git"))
    pair = F.from_json("_git", "map<string,array<string>>")[F.col("cwd")]
    joined = events.join(F.broadcast(sources), "source_file")  # a row for each file; else small events were taken for the side to send
    return joined.withColumns({"config_version": F.coalesce("_version", "config_version"), "git_branch": F.coalesce(pair[0], F.col("git_branch")), "git_commit": F.coalesce(pair[1], F.col("git_commit"))}).drop("_version", "_git")


def folded_sessions(rows: DataFrame) -> DataFrame:
    """Sessions from their rows by file: fields folded, counters added up, the
    largest context."""
    return N.fold_sessions(rows).where("total_events > 0")


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        """``buckets`` is the number of session parts of a new store."""
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[tuple[int, str]]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [str(f.getPath()) for f in fs.listStatus(path(self.folder))]
        return sorted((int(m[1]), n) for n in names if (m := POINTER.search(n)))

    def _pointed(self) -> dict:
        found = self._pointers()
        told = json.loads("\n".join(r.value for r in self.spark.read.text(found[-1][1]).collect())) if found else {"tables": {}}
        if found and "buckets" not in told:
            raise ValueError("a store of an older layout: make it anew from its logs")
        self.buckets = told.get("buckets", self.buckets)
        return told

    def current(self) -> dict[str, list[str]]:
        """The parts of each table."""
        return self._pointed()["tables"]

    def _point(self, tables: dict[str, list[str]]) -> None:
        fs, path = self._fs()
        found = self._pointers()
        new = path(f"{self.folder}/.new-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "buckets": self.buckets, "tables": tables}).encode()))
        out.close()
        if not fs.rename(new, path(f"{self.folder}/CURRENT-{found[-1][0] + 1 if found else 1:012d}.json")):
            raise OSError("another writer was faster")
        for _, old in found[:-1]:
            fs.delete(path(old), False)

    def _write(self, name: str, df: DataFrame) -> list[str]:
        """Writes rows as parts of their own, and returns these."""
        folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        if name in BY_FILE:
            key = F.substring(F.sha2("source_file", 256), 1, 16)
        elif name in BY_SESSION:
            key = self.bucket()
        elif name == "postings":
            key = search.bucket(F.col("term")).cast("string")
        else:
            df.write.parquet(folder)
            return [folder]
        # dealt by part, large ones split
        dealt = df.withColumn(KEY, key).hint("rebalance", KEY)
        (dealt.sortWithinPartitions(KEY, "term") if name == "postings" else dealt).write.partitionBy(KEY).parquet(folder)
        fs, path = self._fs()
        made = [str(f.getPath()) for f in fs.listStatus(path(folder)) if f"/{KEY}=" in str(f.getPath())]
        if made:
            return sorted(made)
        df.limit(0).write.parquet(f"{folder}/{KEY}=none")  # the schema, where there are no rows
        return [f"{folder}/{KEY}=none"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("string")

    def write(self, **tables: DataFrame) -> None:
        """New contents of some tables, visible together."""
        parts = self.current()
        self._point(parts | {name: self._write(name, df) for name, df in tables.items()})

    def clean(self) -> int:
        """Deletes the folders that neither of the last two versions names; says how many."""
        fs, path = self._fs()
        kept = set()
        for _, pointer in self._pointers()[-2:]:
            told = json.loads("\n".join(r.value for r in self.spark.read.text(pointer).collect()))
            kept |= {p.partition(f"/{KEY}=")[0].rpartition("/")[2] for parts in told["tables"].values() for p in parts}
        n = 0
        for table in fs.listStatus(path(self.folder)) if fs.exists(path(self.folder)) else []:
            for old in fs.listStatus(table.getPath()) if table.isDirectory() else []:
                if old.getPath().getName() not in kept:
                    n += fs.delete(old.getPath(), True)
        return n

    def init(self) -> None:
        """An empty store; one that is there stays as it is."""
        if not self.current():
            self.ingest_lines(jsonl.scan(self.spark, []))

    def table(self, name: str) -> DataFrame:
        return self._read(self.current(), name)

    def _read(self, parts: dict[str, list[str]], name: str) -> DataFrame:
        if name in parts:
            return self.spark.read.parquet(*parts[name])
        if name in USER_TABLES or name in PRUNED:
            return self.spark.createDataFrame([], (USER_TABLES | PRUNED)[name])
        raise LookupError(f"no table {name}: nothing was ingested")

    def check(self) -> str:
        """ok, empty, stale, or the tables that are missing."""
        if not self._pointers():
            return "empty"
        told = self._pointed()
        if told.get("schema") != SCHEMA_VERSION:
            return "stale"
        missing = [t for t in TABLES if t not in told["tables"] and t not in USER_TABLES]
        return "missing: " + ", ".join(missing) if missing else "ok"

    # ingest

    def ingest(self, paths: list[str], **known) -> dict[str, int]:
        """Adds log files."""
        return self.ingest_lines(jsonl.scan(self.spark, paths), **known)

    def ingest_if_older(self, paths: Callable[[], list[str]], seconds: float, **known) -> dict[str, int] | None:
        """Ingests unless the last change of the tables is younger than this;
        then None, and the files are not even listed."""
        fs, path = self._fs()
        found = self._pointers()
        if found and time.time() - fs.getFileStatus(path(found[-1][1])).getModificationTime() / 1000 < seconds:
            return None
        return self.ingest(paths(), **known)

    def ingest_lines(self, lines: DataFrame, config_version: str | None = None, git: dict[str, tuple[str, str]] | None = None) -> dict[str, int]:
        """Adds lines (source_file, raw_index, raw_line), with what is known when
        they come in: the configuration's version, and branch and commit by
        working folder. Both stay with the lines and win over the payload.

        Says what came of these lines, and how many sessions and tool calls there
        are now. Of equal events the one that was stored first stays."""
        text = "string"
        # dealt anew: parsing is the dear part, and lines may come in one large part
        lines = materialize(lines.withColumn("config_version", F.lit(config_version).cast(text)).withColumn("git", F.lit(json.dumps(git) if git else None).cast(text)).repartition("source_file", "raw_index"), "lines")
        parts = self.current()
        lines, replaced = self._named(lines, parts)
        added = {"lines": self._write("lines", lines)}
        rest = self._without(parts, replaced)
        return self._derive(rest, lines, added, replaced, set(parts.get("events", [])) - set(rest.get("events", [])))

    def _named(self, lines: DataFrame, parts: dict[str, list[str]]) -> tuple[DataFrame, set[str]]:
        """The lines under the names that their files are kept by, and the names
        that are stored and come again whole."""
        stored = {part_key(p) for p in parts.get("lines", [])}
        newest = {}
        for (name,) in lines.select("source_file").distinct().collect():  # files of one ingest
            n = 1
            while file_key(generation(name, n)) in stored:
                newest[name] = generation(name, n)
                n += 1
        if not newest:
            return lines, set()
        names = F.broadcast(self.spark.createDataFrame(list(newest.items()), "source_file string, _newest string"))  # at most a row for each file
        again = lines.join(names, "source_file").select(F.col("_newest").alias("source_file"), "raw_index", "raw_line")
        keys = {file_key(v) for v in newest.values()}
        old = self._read({"lines": [p for p in parts["lines"] if part_key(p) in keys]}, "lines")
        lost = {r[0] for r in old.join(again, ["source_file", "raw_index", "raw_line"], "left_anti").select("source_file").distinct().collect()}
        kept = [(k, generation(k, int(v.removeprefix(k + "#") if v != k else 1) + 1) if v in lost else v) for k, v in newest.items()]
        names = F.broadcast(self.spark.createDataFrame(kept, "source_file string, _name string"))
        named = lines.join(names, "source_file", "left").withColumn("source_file", F.coalesce("_name", "source_file")).select(*lines.columns)
        return materialize(named, "lines"), set(newest.values()) - lost

    def _without(self, parts: dict[str, list[str]], names: set[str]) -> dict[str, list[str]]:
        """The parts less those of these files."""
        keys = {file_key(n) for n in names}
        return {t: [p for p in v if part_key(p) not in keys] if t in BY_FILE else v for t, v in parts.items()}

    def rebuild(self, since: str | None = None) -> dict[str, int]:
        """All derived tables from the kept lines; with ``since`` from those of
        files of that day and later, rows of older files stay as they are."""
        parts = self.current()
        lines = self.table("lines")
        if since is None:
            return self._derive({k: v for k, v in parts.items() if k not in DERIVED}, materialize(lines, "lines"), {}, set(), set())
        recent = F.coalesce(F.regexp_extract("source_file", r"(\d{4}-\d\d-\d\d)", 1) >= since, F.lit(False))
        lines = materialize(lines.where(recent), "lines")
        names = {r[0] for r in lines.select("source_file").distinct().collect()}
        keys = {file_key(n) for n in names}
        kept = [p for p in parts["events"] if part_key(p) not in keys]
        return self._derive(parts | {"events": kept}, lines, {}, names, set(parts["events"]) - set(kept))

    def _derive(self, parts: dict[str, list[str]], lines: DataFrame, added: dict[str, list[str]], replaced: set[str], gone_events: set[str]) -> dict[str, int]:
        """Adds to ``parts`` what is in ``added`` and what follows from written
        lines, where rows of ``replaced`` files are theirs, and points to it.
        ``gone_events`` are the parts of events that the new ones stand for."""
        raw = materialize(known(jsonl.events(jsonl.envelopes(lines)), lines), "raw")  # parsed once
        size = F.col("input_bytes") + F.col("output_bytes") + F.coalesce("prompt_length", F.lit(0))
        numbered = materialize(N.running(N.tool_duration(raw), {"_n": F.lit(1), "context_cumulative_bytes": size}).withColumn("sequence_num", F.col("_n") - 1).drop("_n"), "numbered")
        n_events = numbered.count()
        stored = self._read(parts, "events") if parts.get("events") else None
        # duplicates take part in numbers and pairs before they go
        fresh = materialize(N.first_of_hash(numbered, stored, n_events), "fresh")
        cut, gone = self._read(parts, "pruned_files"), self._read(parts, "pruned_rows")
        late = lambda df, at: df.join(cut, "source_file", "left").where(F.col("cutoff").isNull() | (F.coalesce(F.to_date(F.substring(at, 1, 10)).cast("string"), F.lit("9")) >= F.col("cutoff"))).drop("cutoff")
        # rows of sessions and calls come from all events, counters from the stored ones
        rows = N.session_rows(numbered).join(N.counters(fresh, N.GROUP), list(N.GROUP), "left").join(gone, list(N.GROUP), "left_anti")
        new = {"session_rows": rows, "tool_call_rows": late(N.tool_call_rows(numbered), "started_at")}
        touched = materialize(numbered.select("session_id").distinct().withColumn("_bucket", self.bucket()), "touched")
        hit = {r[0] for r in touched.select("_bucket").distinct().collect()}
        wrote, read = dict(added), self._read
        for name, df in new.items():
            old = [p for p in parts.get(name, []) if part_key(p) in hit]
            if old:
                here = read({name: old}, name)
                if replaced:
                    names = F.broadcast(self.spark.createDataFrame([(r,) for r in replaced], "source_file string"))  # files of one ingest
                    here = here.join(names, "source_file", "left_anti")
                df = here.unionByName(df)
            wrote[name] = self._write(name, df)
        here = materialize(folded_sessions(read(wrote, "session_rows")), "sessions")
        lineage = ("session_id", "parent_session_id", "chain_id")
        was = self._read(parts, "sessions") if parts.get("sessions") else here.where("false").withColumns({c: F.lit(None).cast("string") for c in lineage[1:]})
        others = [p for p in parts.get("sessions", []) if part_key(p) not in hit]
        now = here.join(was.select(*lineage), "session_id", "left")
        if others:
            now = now.unionByName(self._read({"sessions": others}, "sessions"))
        moved = materialize(N.relinked(now, was, touched.select("session_id")).withColumn("_bucket", self.bucket()), "moved")
        far = {r[0] for r in moved.select("_bucket").distinct().collect()} | hit
        again = moved.select("session_id", F.col("parent_session_id").alias("_parent"), F.col("chain_id").alias("_chain"), F.lit(True).alias("_moved"))
        sessions = now.where(self.bucket().isin(list(far))).join(again, "session_id", "left")
        either = lambda moved, own: F.when(F.col("_moved"), F.col(moved)).otherwise(F.col(own))
        sessions = sessions.withColumns({"parent_session_id": either("_parent", "parent_session_id"), "chain_id": either("_chain", "chain_id")}).drop("_parent", "_chain", "_moved")
        wrote |= {"sessions": self._write("sessions", sessions), "tool_calls": self._write("tool_calls", N.fold_tool_calls(read(wrote, "tool_call_rows"))), "events": self._write("events", late(fresh, "timestamp"))}
        kept = {t: [p for p in v if t not in BY_SESSION or part_key(p) not in (far if t == "sessions" else hit)] for t, v in parts.items()}
        kept, wrote = self._indexed(kept, wrote, gone_events)
        n_lines, n_fresh = lines.count(), read(wrote, "events").count()
        whole = kept | {t: [*kept.get(t, []), *v] for t, v in wrote.items()}
        # a part without rows only stands where there is no other
        self._point({t: [p for p in v if part_key(p) != "none"] or v[:1] for t, v in whole.items()})
        return {"events_seen": n_events, "events_stored": n_fresh, "duplicates": n_events - n_fresh, "malformed": n_lines - n_events, "sessions": self.table("sessions").count(), "tool_calls": self.table("tool_calls").count()}

    def _indexed(self, kept: dict[str, list[str]], wrote: dict[str, list[str]], gone_events: set[str]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
        """Adds the new events' texts to the index. Of a hash of terms with many
        parts, one is made."""
        new = self._read(wrote, "events")
        if gone_events:  # the index has them
            new = new.join(self._read({"events": sorted(gone_events)}, "events").select("event_hash"), "event_hash", "left_anti")
        texts = search.postings(new, "event_hash", TEXTS)
        crowded = {k for k, n in Counter(map(part_key, kept.get("postings", []))).items() if n >= CROWDED}
        made = self._write("postings", texts)
        size = search.totals(self._read({"postings": made}, "postings"))
        if kept.get("index_size"):
            size = size.unionByName(self._read(kept, "index_size")).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        if crowded:
            many = [p for p in (*kept["postings"], *made) if part_key(p) in crowded]
            made = [p for p in made if part_key(p) not in crowded] + self._write("postings", self._read({"postings": many}, "postings"))
        rest = {t: [p for p in v if not (t == "postings" and part_key(p) in crowded)] for t, v in kept.items() if t != "index_size"}
        return rest, wrote | {"postings": made, "index_size": self._write("index_size", size)}

    # search

    def search(self, asked: list[str], limit: int | None = 50) -> DataFrame:
        """Events with all these words in their texts, best first: score,
        event_hash, session_id, timestamp, event_type. Of the index only the parts
        of these words are read."""
        parts = self.current()
        at = set(map(str, search.buckets_of(self.spark, asked)))
        held = [p for p in parts.get("postings", []) if part_key(p) in at]
        if not held:
            held = parts.get("postings", [])[:1]
        index = search.opened(self._read({"postings": held}, "postings"), asked)
        every = search.all_of(*[search.term(index, w) for w in asked])
        hits = search.ranked(index, asked, every, limit, search.mean_length(self._read(parts, "index_size"))).withColumnRenamed("id", "event_hash")
        return hits.join(self._read(parts, "events").select("event_hash", "session_id", "timestamp", "event_type"), "event_hash").orderBy(F.desc("score"), "event_hash")

    # changes by users

    def annotate(self, prefix: str, label: str, notes: str | None, now: str) -> int:
        """Adds a label to the first session with this prefix; says how many."""
        new = C.by_prefix(self.table("sessions"), prefix).select("session_id", F.lit(label).alias("label"), F.lit(notes).cast("string").alias("notes"), F.lit(now).alias("created_at"))
        n = new.count()
        self.write(annotations=self.table("annotations").unionByName(new))
        return n

    def label(self, description: str, now: str) -> None:
        made = C.label_newest(self.table("sessions"), self.table("config_versions"), description, now)
        self.write(config_versions=made.withColumn("files_snapshot", F.lit(None).cast("string")))

    def prune(self, cutoff: str) -> DataFrame:
        """Removes events, sessions and calls before a day, so that no later
        rebuild brings them back; returns the counts. Files without an event of
        that day or later lose their envelopes; lines that are none stay. Files
        that come later are not cut."""
        parts = self.current()
        tables = {name: self.table(name) for name in C.DATED}
        counts = C.prune_counts(tables, cutoff)
        held = self.spark.createDataFrame(counts.collect(), counts.schema)  # three rows
        gone = C.before(tables["sessions"], "started_at", cutoff).select("session_id")
        lines = jsonl.parse(self.table("lines"))
        files = lines.groupBy("source_file").agg(F.count("*").alias("n"), F.max(F.when(F.col("error").isNull(), F.substring("ts", 1, 10))).alias("last"))
        over = [r[0] for r in files.where(F.coalesce("last", F.lit("")) < cutoff).select("source_file").collect()]  # names of files
        keys = {file_key(n) for n in over}
        old = [p for p in parts["lines"] if part_key(p) in keys]
        rest = [p for p in parts["lines"] if part_key(p) not in keys]
        rows = self.table("session_rows")
        cut = self.table("pruned_files").unionByName(files.select("source_file", F.lit(cutoff).alias("cutoff"))).groupBy("source_file").agg(F.max("cutoff").alias("cutoff"))
        taken = self.table("pruned_rows").unionByName(rows.join(gone, "session_id", "left_semi").select(*N.GROUP))
        made = {
            "session_rows": rows.join(gone, "session_id", "left_anti"),
            "tool_call_rows": C.keep_from(self.table("tool_call_rows"), "started_at", cutoff),
            "pruned_files": cut,
            "pruned_rows": taken,
            **dict(zip(INDEX, (lambda texts: (texts, search.totals(texts)))(self.table("postings").join(C.keep_from(tables["events"], "timestamp", cutoff).select(F.col("event_hash").alias("id")), "id", "left_semi")), strict=True)),
            **{name: C.keep_from(tables[name], column, cutoff) for name, column in C.DATED.items()},
        }
        wrote = {name: self._write(name, df) for name, df in made.items()}
        if old:
            dead = jsonl.malformed(self._read({"lines": old}, "lines")).select("source_file", "raw_index")
            wrote["lines"] = [*rest, *self._write("lines", self._read({"lines": old}, "lines").join(dead, ["source_file", "raw_index"], "left_semi"))]
        self._point(parts | wrote)
        return held

    def backup(self, folder: str) -> None:
        """The current versions of all tables as a store of their own."""
        other = Store(self.spark, folder, self.buckets)
        other.write(**{name: self.table(name) for name in self.current()})

    # SQL

    def sql(self, query: str, write: bool = False) -> DataFrame:
        """Spark SQL over the tables as views. Statements whose first word changes
        data need ``write`` and only reach Spark's own catalogue, not the store."""
        word = (query.split() or [""])[0].upper()
        if word in MUTATIONS and not write:
            raise PermissionError(f"{word} needs write=True")
        for name in self.current():
            if name in TABLES:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)
