"""Stateful enrichment: numbering, pairing, running sums, session and tool-call
rows, upserts, lineage.

Order is the text order of (timestamp, raw_index). Running values are kept by
(source file, session) and computed in two steps, within the hours of a session
and over the hours' totals, so that one very long session spreads over tasks. Rows
before (``lagged``) and the latest value (``latest``) go the same way: a part hands
on its last rows or value, and only parts are looked at in a window over a session.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import events as E
from sessionloom.runtime import materialize

GROUP = ("source_file", "session_id")
ORDER = ("timestamp", "raw_index")
IDENTITY = ("model", "cwd", "config_version", "git_branch")


def running(events: DataFrame, values: dict[str, Column], group: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds running sums in event order. A prefix of the text that is ordered is
    ordered as well, so the first 13 characters (the hour) cut each group into
    parts: sums within a part, plus the sum of the parts before."""
    part = F.substring("timestamp", 1, 13)
    keyed = events.withColumns({"_part": part} | {f"_v_{k}": v for k, v in values.items()})
    totals = keyed.groupBy(*group, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    within = W.partitionBy(*group, "_part").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = keyed.join(offsets, [*group, "_part"]).withColumns({k: F.sum(f"_v_{k}").over(within) + F.col(f"_o_{k}") for k in values})
    return summed.drop("_part", *[f"_{x}_{k}" for k in values for x in "vo"])


def lagged(events: DataFrame, value: Column, k: int, group: tuple[str, ...] = ("session_id",), order: tuple[str, ...] = ("source_file", *ORDER), wanted: Column | None = None) -> DataFrame:
    """Adds ``before``: the values, as structs of v, of the k rows before a row in
    its group, the nearest last. Rows other than ``wanted`` are left out after
    they were counted.

    A group is cut into parts by hour, and by file where order begins with it. The
    last k values of a part are all that later parts need of it, and as each part
    has a row, they need no more than the k parts before: what is carried on is
    bounded, and a task has an hour of a group at most."""
    own = [*group, "_part"]
    keyed = events.withColumns({"_part": F.struct(*[c for c in order if c == "source_file"], F.substring("timestamp", 1, 13).alias("hour")), "_v": F.struct(value.alias("v"))})
    newest = F.row_number().over(W.partitionBy(*own).orderBy(*[F.desc(c) for c in order]))
    # all but k rows of a part go before they are shuffled
    rows = keyed.select(*own, *[c for c in order if c not in group], "_v").withColumn("_r", newest).where(F.col("_r") <= k)
    tails = rows.groupBy(*own).agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_r", "_v")))), lambda x: x["_v"]).alias("_tail"))
    last = lambda values: F.when(F.size(values) > k, F.slice(values, -k, k)).otherwise(values)
    carried = F.flatten(F.collect_list("_tail").over(W.partitionBy(*group).orderBy("_part").rowsBetween(-k, -1)))
    carry = tails.select(*own, carried.alias("_carry")).where(F.size("_carry") > 0).select(*own, last(F.col("_carry")).alias("_carry"))
    within = F.collect_list("_v").over(W.partitionBy(*own).orderBy(*order).rowsBetween(-k, -1))
    found = keyed.withColumn("_own", within)
    found = (found if wanted is None else found.where(wanted)).join(carry, own, "left")
    return found.withColumn("before", last(F.concat(F.coalesce("_carry", F.array()), "_own"))).select(*events.columns, "before")


def latest(rows: DataFrame, value: Column, group: tuple[str, ...], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``latest``: the last value that is not null of a row's group up to the
    row itself. The last value of each hour is an aggregate; it is handed to the
    hours after it, where they have none of their own. The group's columns are
    not null."""
    own = [*group, "_part"]
    keyed = rows.withColumns({"_part": F.substring("timestamp", 1, 13), "_v": value})
    ends = keyed.groupBy(*own).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carry = ends.select(*own, carried.alias("_carry")).where("_carry IS NOT NULL")
    within = F.last("_v", ignorenulls=True).over(W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return keyed.withColumn("_v", within).join(carry, own, "left").select(*rows.columns, F.coalesce("_v", "_carry").alias("latest"))


def tool_duration(events: DataFrame) -> DataFrame:
    """duration_ms of each tool end: time since the last start in the same file
    and session with its tool_use_id, be it earlier or later."""
    has_id = F.coalesce(F.col("tool_use_id") != "", F.lit(False))
    starts = events.where((F.col("event_type") == "PreToolUse") & has_id).groupBy(*GROUP, "tool_use_id").agg(F.max_by("timestamp", F.struct(*ORDER)).alias("_pre"))
    joined = events.join(starts, [*GROUP, "tool_use_id"], "left")
    made = F.when(F.col("event_type").isin(*E.TOOL_END), E.millis_between(F.col("_pre"), F.col("timestamp")))
    return joined.withColumn("duration_ms", made).drop("_pre")


def enrich(raw: DataFrame) -> DataFrame:
    """The events table: projections, sequence_num, duration_ms and
    context_cumulative_bytes."""
    projected = tool_duration(E.with_projections(raw))
    size = F.col("input_bytes") + F.col("output_bytes") + F.coalesce("prompt_length", F.lit(0))
    return running(projected, {"_n": F.lit(1), "context_cumulative_bytes": size}).withColumn("sequence_num", F.col("_n") - 1).drop("_n")


FEW_HASHES = 1_000_000  # of 16 characters: a batch with no more goes to where the stored ones are


def first_of_hash(events: DataFrame, stored: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """One event of each event_hash, the first in order; none that is stored.

    ``batch`` is how many events there are, if it is known. The hashes of a small
    batch are sent around to look for them among the stored ones, which then stay
    where they are; the few that are found are taken out of the batch."""
    rank = F.row_number().over(W.partitionBy("event_hash").orderBy(*ORDER, "source_file"))
    fresh = events.withColumn("_r", rank).where("_r = 1").drop("_r")
    if stored is None:
        return fresh
    if batch is None or batch > FEW_HASHES:
        return fresh.join(stored.select("event_hash"), "event_hash", "left_anti")
    known = stored.select("event_hash").join(F.broadcast(events.select("event_hash").distinct()), "event_hash", "left_semi")
    return fresh.join(known, "event_hash", "left_anti")


def session_rows(events: DataFrame, counted: dict[str, Column] | None = None) -> DataFrame:
    """One row per file and session: from its first SessionStart (else its first
    event), its last SessionEnd, and its bytes at the last automatic compaction;
    with ``counted`` (``counts``) these counters of the same rows."""
    at, identity = F.struct(*ORDER), [*IDENTITY, *(c for c in ("git_commit",) if c in events.columns)]
    start = F.min(F.struct((F.col("event_type") != "SessionStart").alias("other"), *ORDER, "source", *identity)).alias("s")
    end = F.max(F.when(F.col("event_type") == "SessionEnd", F.struct(*ORDER, "reason"))).alias("e")
    auto = F.max_by("context_cumulative_bytes", F.when((F.col("event_type") == "PreCompact") & (F.col("compact_trigger") == "auto"), at)).alias("context_at_compact")
    counted = counted or {}
    rows = events.groupBy(*GROUP).agg(start, end, auto, *[v.alias(k) for k, v in counted.items()])
    return rows.select(
        *GROUP,
        F.col("s.timestamp").alias("started_at"),
        F.col("e.timestamp").alias("ended_at"),
        F.col("s.source").alias("source"),
        F.col("e.reason").alias("end_reason"),
        *[F.col(f"s.{c}").alias(c) for c in identity],
        "context_at_compact",
        *counted,
    )


def fold_sessions(rows: DataFrame) -> DataFrame:
    """Upsert of session rows file by file: started_at is the first, any other
    column the last that is not null; counters are added up, of the context the
    largest counts."""
    rest = [c for c in rows.columns if c not in (*GROUP, "started_at", *COUNTED, LARGEST)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("source_file"))).alias(c) for c in rest]
    added = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED if c in rows.columns]
    most = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in (LARGEST,) if c in rows.columns]
    return rows.groupBy("session_id").agg(F.min_by("started_at", "source_file").alias("started_at"), *last, *added, *most)


def tool_call_rows(events: DataFrame) -> DataFrame:
    """One row per tool end that has an id, paired with the latest earlier start
    of its file, session and id; without one it keeps its own time."""
    kept = ("timestamp", "tool_name", "agent_id", "agent_type", "skill_name", "skill_type")
    pre = F.when(F.col("event_type") == "PreToolUse", F.struct(*kept, F.substring("tool_input", 1, 200).alias("input_summary")))
    tool = events.where(F.col("tool_use_id").isNotNull() & F.col("event_type").isin("PreToolUse", *E.TOOL_END))
    needed = (*GROUP, *ORDER, "event_type", "tool_use_id", "tool_input", *kept[1:], "duration_ms", "output_bytes", "error")
    ends = latest(tool.select(*needed), pre, (*GROUP, "tool_use_id")).where(F.col("event_type").isin(*E.TOOL_END)).withColumnRenamed("latest", "_pre")
    failed = F.col("event_type") == "PostToolUseFailure"
    either = lambda c: F.coalesce(F.col(c), F.col(f"_pre.{c}")).alias(c)
    return ends.select(
        *GROUP,
        "raw_index",
        "tool_use_id",
        F.coalesce("tool_name", "_pre.tool_name", F.lit("")).alias("tool_name"),
        either("agent_id"),
        either("agent_type"),
        F.coalesce("_pre.timestamp", "timestamp").alias("started_at"),
        F.col("timestamp").alias("completed_at"),
        "duration_ms",
        F.col("_pre.input_summary").alias("input_summary"),
        "output_bytes",
        F.when(failed, F.col("error")).alias("error"),
        F.when(failed, 0).otherwise(1).cast("long").alias("succeeded"),
        either("skill_name"),
        either("skill_type"),
    )


def fold_tool_calls(rows: DataFrame) -> DataFrame:
    """Upsert by (session_id, tool_use_id) in order: identity columns of the
    first, results the last that is not null; a later error makes it fail."""
    at = F.struct("source_file", "completed_at", "raw_index")
    first = [F.min_by(c, at).alias(c) for c in ("tool_name", "agent_id", "agent_type", "started_at", "input_summary")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("completed_at", "duration_ms", "output_bytes", "error", "skill_name", "skill_type")]
    # the last error comes from a later row unless it is the first row's own
    folded = rows.groupBy("session_id", "tool_use_id").agg(*first, *last, F.min_by("succeeded", at).alias("_s"), F.max(F.when(F.col("error").isNotNull(), at)).alias("_e"), F.min(at).alias("_f"))
    return folded.withColumn("succeeded", F.when(F.col("_e") > F.col("_f"), 0).otherwise(F.col("_s")).cast("long")).drop("_s", "_e", "_f")


COUNTED = ("total_events", "total_tool_calls", "total_failures", "total_prompts", "total_subagents", "total_tasks", "compaction_count", "auto_compact_count", "permission_prompts")
LARGEST = "context_total_bytes"


def counts() -> dict[str, Column]:
    """The counters of a group of events, as aggregates."""
    n = lambda cond: F.count_if(cond)
    et = F.col("event_type")
    found = (
        F.count("*"),
        n(et == "PreToolUse"),
        n(et == "PostToolUseFailure"),
        n(et == "UserPromptSubmit"),
        n(et == "SubagentStart"),
        n(et == "TaskCompleted"),
        n((et == "SessionStart") & (F.col("source") == "compact")),
        n((et == "PreCompact") & (F.col("compact_trigger") == "auto")),
        n(et == "PermissionRequest"),
    )
    return dict(zip(COUNTED, found, strict=True)) | {LARGEST: F.max(F.coalesce("context_cumulative_bytes", F.lit(0)))}


def counters(events: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """All counters of a session (or of each of ``by``) in one aggregation."""
    return events.groupBy(*by).agg(*[v.alias(k) for k, v in counts().items()])


def sessions(events: DataFrame) -> DataFrame:
    """Sessions with their counters; events, which are dear, are gone through once."""
    return fold_sessions(session_rows(events, counts())).where("session_id IS NOT NULL")


# lineage

# Look-back, least score, and the points of gaps and of equal fields below.
LOOK_BACK_S = 1800
LEAST_SCORE = 6
GAP_POINTS = ((30, 5), (120, 4), (300, 3), (900, 2), (LOOK_BACK_S, 1))
FIELD_POINTS = {"cwd": 3, "git_branch": 2, "model": 1}
STAYS_POINTS = 2
NO_ROOT = "\u0000"  # no session is called so


def lineage_score(prev: str, cur: str) -> Column:
    """How well session ``prev`` (struct column) explains the start of ``cur``."""
    gap, near = gap_seconds(prev, cur), F.lit(0)
    for most, points in reversed(GAP_POINTS):
        near = F.when(gap < most, points).otherwise(near)
    same = lambda c, points: F.when((F.col(f"{prev}.{c}") == F.col(f"{cur}.{c}")) & (F.col(f"{prev}.{c}") != ""), points).otherwise(0)
    stays = F.when(F.col(f"{prev}.end_reason").eqNullSafe("logout"), 0).otherwise(STAYS_POINTS)
    return near + sum((same(c, points) for c, points in FIELD_POINTS.items()), F.lit(0)) + stays


def gap_seconds(prev: str, cur: str) -> Column:
    return E.div(F.unix_micros(E.parse_ts(F.col(f"{cur}.started_at"))) - F.unix_micros(E.parse_ts(F.col(f"{prev}.ended_at"))), 1_000_000)


def parents(sessions: DataFrame, within: tuple[str, ...] = (), of: DataFrame | None = None) -> DataFrame:
    """(session_id, parent_session_id, score) of sessions that continue another:
    of the sessions ended before it started, newest first up to and including
    the first that ended over 30 minutes before, the one that scores highest,
    at least LEAST_SCORE; of equal scores the newest. ``within`` names columns
    that both must share (an owner, a host). ``of`` has the session_ids to find
    parents for, if not for all; the others are then looked at only where they
    ended within an hour before the first of these, later, or as the last before.

    No pairs are made. A newer session that shares the same fields and ended in
    the same way scores at least as high, so the best one is the newest of those
    that share some set of fields and way of ending: an as-of lookup for each such
    set, in windows of half-hour slots that a session's end and the three slots
    from there on share. The newest one beyond the look-back is an as-of lookup
    of its own, in its slot or the nearest used slot before. Work is linear in
    the sessions."""
    slot = lambda ts: F.floor(F.unix_seconds(ts) / LOOK_BACK_S)
    fields = ("session_id", "started_at", "ended_at", "cwd", "git_branch", "model", "end_reason")
    # written, as several lookups come from it
    eligible = materialize(sessions.where(F.col("source").isin("startup", "resume")).select(*within, *[f for f in fields if f not in within]), "eligible")
    side = lambda name, text: eligible.withColumn("_at", E.parse_ts(F.col(text))).where("_at IS NOT NULL").select(*within, F.struct("_at", *fields).alias(name))
    ended, started = side("prev", "ended_at"), side("cur", "started_at")
    if of is not None:
        started = started.join(of.select(F.col("session_id").alias("_of")), F.col("cur.session_id") == F.col("_of"), "left_semi")
        if not within:
            first, last = started.agg(F.min("cur._at"), F.max("cur._at")).first()
            early = F.unix_seconds("prev._at") < F.unix_seconds(F.lit(first)) - 2 * LOOK_BACK_S
            # three: one may be the session itself, and two are compared
            ended = materialize(ended.where((F.col("prev._at") <= F.lit(last)) & ~early).unionByName(ended.where(early).orderBy(F.col("prev._at").desc(), F.col("prev.session_id").desc()).limit(3)), "ended")
    sets = [[c for c in FIELD_POINTS if c in chosen] for n in range(len(FIELD_POINTS) + 1) for chosen in combinations(FIELD_POINTS, n)]
    filled = lambda name, own: F.forall(F.array(F.lit("x"), *[F.col(f"{name}.{c}") for c in own]), lambda v: F.coalesce(v != "", F.lit(False)))
    keys = lambda name: F.array(*[F.when(filled(name, own), F.concat_ws("\u0001", F.lit(str(k)), *[F.col(f"{name}.{c}") for c in own])) for k, own in enumerate(sets)])
    looked = lambda df, name, slots, left: df.select(*within, name, F.explode(F.filter(keys(name), lambda k: k.isNotNull())).alias("key"), slots.alias("slots"), left.alias("ways")).withColumn("slot", F.explode("slots")).withColumn("way", F.explode("ways")).drop("slots", "ways")
    here = slot(F.col("prev._at"))
    lefts = looked(ended, "prev", F.array(here, here + 1, here + 2), F.array(F.col("prev.end_reason").eqNullSafe("logout")))
    rights = looked(started, "cur", F.array(slot(F.col("cur._at"))), F.array(F.lit(True), F.lit(False)))
    near = as_of(lefts, rights, (*within, "key", "slot", "way")).select(*within, "cur", "prev").where(gap_seconds("prev", "cur") <= LOOK_BACK_S)
    # beyond: at the last moment from which the gap counts as longer
    asked = started.withColumn("_before", F.timestamp_micros(F.unix_micros("cur._at") - (LOOK_BACK_S + 1) * 1_000_000))
    asked = asked.withColumn("cur", F.struct(F.col("_before").alias("_at"), F.col("cur").alias("_cur"), F.col("cur.session_id").alias("session_id"))).withColumn("slot", slot(F.col("_before"))).drop("_before")
    placed = ended.withColumn("slot", slot(F.col("prev._at")))
    inside = as_of(placed, asked, (*within, "slot")).select(*within, F.col("cur._cur").alias("cur"), "prev")
    # in no own slot: the newest two of the nearest slot before that has any, one of which may be the session itself
    by_slot = W.partitionBy(*within).orderBy("slot")
    newest_two = placed.withColumn("_r", F.row_number().over(W.partitionBy(*within, "slot").orderBy(F.col("prev._at").desc(), F.col("prev.session_id").desc()))).where("_r <= 2").drop("_r")
    used = placed.select(*within, "slot").distinct().withColumn("used", F.array("slot", F.lag("slot").over(by_slot)))
    wanted = asked.select(*within, "slot").distinct().withColumn("used", F.lit(None).cast("array<long>"))
    nearest = used.unionByName(wanted).withColumn("used", F.last("used", ignorenulls=True).over(by_slot.rangeBetween(W.unboundedPreceding, -1))).distinct().select(*within, F.col("slot").alias("to"), F.explode("used").alias("slot")).where("slot IS NOT NULL")
    outside = asked.withColumnRenamed("slot", "to").join(nearest, [*within, "to"]).join(newest_two, [*within, "slot"]).select(*within, F.col("cur._cur").alias("cur"), "prev").where("prev.session_id <> cur.session_id")
    newest = [F.col("prev._at").desc(), F.col("prev.session_id").desc()]
    key = F.col("cur.session_id")
    # at most one near row for each set of fields and way of ending, and three beyond, for each session
    scored = near.unionByName(inside).unionByName(outside).withColumns({"score": lineage_score("prev", "cur"), "beyond": gap_seconds("prev", "cur") > LOOK_BACK_S})
    scored = scored.withColumn("_r", F.row_number().over(W.partitionBy(key, "beyond").orderBy(*newest))).where("NOT beyond OR _r = 1")
    best = scored.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), *newest))).where("_r = 1")
    return best.where(F.col("score") >= LEAST_SCORE).select(key.alias("session_id"), F.col("prev.session_id").alias("parent_session_id"), F.col("score").cast("long").alias("score"))


def as_of(lefts: DataFrame, rights: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, cur, prev): for each row of ``rights`` (by, cur) the newest of
    ``lefts`` (by, prev) with the same ``by`` whose prev._at is not after cur._at,
    and whose session is another. Every left row carries the one before it, for
    rights whose newest is themselves."""
    order = [F.col("prev._at"), F.col("prev.session_id")]
    two = lefts.withColumn("two", F.struct(F.col("prev").alias("one"), F.lag("prev").over(W.partitionBy(*by).orderBy(*order)).alias("other")))
    rows = two.select(*by, F.col("prev._at").alias("_at"), F.lit(0).alias("_kind"), F.col("prev.session_id").alias("_id"), "two", F.lit(None).cast(rights.schema["cur"].dataType).alias("cur"))
    rows = rows.unionByName(rights.select(*by, F.col("cur._at").alias("_at"), F.lit(1).alias("_kind"), F.col("cur.session_id").alias("_id"), F.lit(None).cast(two.schema["two"].dataType).alias("two"), "cur"))
    seen = F.last("two", ignorenulls=True).over(W.partitionBy(*by).orderBy("_at", "_kind", "_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = rows.withColumn("two", seen).where("_kind = 1")
    prev = F.when(F.col("two.one.session_id") == F.col("cur.session_id"), F.col("two.other")).otherwise(F.col("two.one"))
    return found.select(*by, "cur", prev.alias("prev")).where("prev IS NOT NULL")


def chains(edges: DataFrame) -> DataFrame:
    """(session_id, chain_id): the root that the parent edges lead to, by pointer
    doubling, so the rounds grow with the logarithm of the longest chain. Roots
    themselves have no chain. A session may end before it starts (a log without its
    first start), so edges can lead in a ring; what leads into one has no root, and
    no row here.

    In a round those move on that are more than 1, 2, 4, ... edges from their root,
    or have none. Where as many move as in the round before, no root is that far
    away, as the sessions on the way to it would be nearer; the rest has none."""
    hop = materialize(edges.select("session_id", F.col("parent_session_id").alias("chain_id")), "hops")
    moving = hop.count()
    while True:
        on = hop.select(F.col("session_id").alias("chain_id"), F.col("chain_id").alias("further"))
        step = hop.join(on, "chain_id", "left").select("session_id", F.coalesce("further", "chain_id").alias("chain_id"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "hops")
        before, moving = moving, step.where("moved").count()
        if moving in (0, before):
            return step.where("NOT moved").select("session_id", "chain_id")
        hop = step.select("session_id", "chain_id")


def with_lineage(sessions: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Sessions with parent_session_id and chain_id; sessions and edges are each
    looked at several times, so they are written once."""
    sessions = materialize(sessions, "sessions")
    edges = materialize(parents(sessions, within), "edges")
    return sessions.join(edges.select("session_id", "parent_session_id"), "session_id", "left").join(chains(edges), "session_id", "left")


def affected(sessions: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """(session_id) of the sessions whose parent may be another than it was:
    ``touched`` ones (session_id), and those that start where the end of a touched
    one, as it is in ``sessions`` or was in ``before``, can count: from that end on,
    up to half an hour after the second later end of an untouched session. By slots
    of half an hour, of which there are few."""
    slot = lambda c: F.floor(F.unix_seconds(E.parse_ts(F.col(c))) / LOOK_BACK_S)
    all_ends = lambda df: df.select(slot("ended_at").alias("slot")).where("slot IS NOT NULL").distinct()
    moved = all_ends(sessions.join(touched, "session_id", "left_semi")).union(all_ends(before.join(touched, "session_id", "left_semi"))).distinct()
    used = all_ends(sessions.join(touched, "session_id", "left_anti"))
    starts = sessions.select("session_id", slot("started_at").alias("slot"))
    by_slot = W.orderBy("slot")  # over slots of time, not sessions
    two = used.withColumn("two", F.struct(F.col("slot").alias("one"), F.lead("slot").over(by_slot).alias("other"))).withColumn("moved", F.lit(False))
    line = two.unionByName(moved.withColumns({"two": F.lit(None).cast(two.schema["two"].dataType), "moved": F.lit(True)}))
    reach = F.coalesce(F.first("two", ignorenulls=True).over(by_slot.rangeBetween(1, W.unboundedFollowing))["other"] + 2, F.lit(1 << 40))
    until = line.withColumn("until", reach).where("moved").select("slot", "until")
    asked = starts.select("slot").where("slot IS NOT NULL").distinct().withColumn("until", F.lit(None).cast("long"))
    reached = F.max("until").over(by_slot.rangeBetween(W.unboundedPreceding, 0)) >= F.col("slot")
    hit = until.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True))).withColumn("hit", reached).where("asked AND hit").select("slot")
    return starts.join(hit, "slot", "left_semi").select("session_id").union(touched.select("session_id").join(sessions, "session_id", "left_semi").select("session_id")).distinct()


def relinked(sessions: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """(session_id, parent_session_id, chain_id) of the sessions whose lineage has
    to be written anew. ``sessions`` are all sessions as they are now, with the
    lineage they had (null for new ones); ``before`` are at least the touched ones
    as they were.

    Only affected sessions look for a parent again, and only the chains that a
    changed edge was in, or leads out of, are followed again; a parent in any other
    chain stands for the root it had. Sessions without a root (``chains``) are
    followed as if they were one chain."""
    asked = materialize(affected(sessions, before, touched), "affected")
    found = parents(sessions, of=asked).select("session_id", F.col("parent_session_id").alias("_new"))
    old = sessions.select("session_id", "parent_session_id", "chain_id", F.coalesce("chain_id", F.when(F.col("parent_session_id").isNull(), F.col("session_id")), F.lit(NO_ROOT)).alias("_root"))
    now = materialize(asked.join(found, "session_id", "left"), "parents")
    # touched ones always: a new session, or one that comes back, may be the root of others
    changed = old.join(now, "session_id").join(touched.select("session_id", F.lit(True).alias("_touched")), "session_id", "left").where("_touched OR NOT (_new <=> parent_session_id)")
    roots = changed.select("_root").union(changed.select(F.col("session_id").alias("_root"))).distinct()
    members = old.join(roots, "_root", "left_semi").join(now.withColumn("_asked", F.lit(True)), "session_id", "left")
    members = materialize(members.select("session_id", F.when(F.col("_asked"), F.col("_new")).otherwise(F.col("parent_session_id")).alias("parent_session_id")), "members")
    outside = old.join(members, "session_id", "left_anti").select(F.col("session_id").alias("parent_session_id"), F.col("_root").alias("_end"))
    edges = members.where("parent_session_id IS NOT NULL").join(outside, "parent_session_id", "left")
    found = chains(edges.select("session_id", F.coalesce("_end", "parent_session_id").alias("parent_session_id")))
    return members.join(found.withColumn("chain_id", F.nullif("chain_id", F.lit(NO_ROOT))), "session_id", "left")


def lineage_candidates(sessions: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """The oldest ``limit`` sessions that ended within 30 minutes before now."""
    since = F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 30 MINUTES")
    return sessions.where(E.parse_ts(F.col("ended_at")) > since).orderBy("ended_at", "session_id").limit(limit).select("session_id", "ended_at", "cwd", "git_branch", "model", "end_reason", "source")
