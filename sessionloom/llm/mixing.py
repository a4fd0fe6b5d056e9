"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of tokens. The cells'
weights are raked to target shares of each source, language and topic in turn
until all three marginals hold within TOLERANCE; a cell's ratio of raked to natural
share is its weight. Raking then goes on with the cells' expected tokens, none over
the tokens it has, until the expected sample has ``budget`` of all tokens and meets
the targets within TOLERANCE (``bound``). Expected tokens over tokens are the
probability of a cell's documents, which are drawn by a hash of their id.
DataFrame functions only.

However slowly the marginals close in, raking goes on for up to MOST_SWEEPS sweeps;
what is missed then is said in a warning. Targets are called impossible only where
that is shown: a value is to have more than all values of another dimension that it
occurs with (``impossible``). Raking such targets ends once it stands still, and
the last dimension (topic) holds exactly.

A value whose target is more than all of its tokens cannot meet it: ``budget``
times its target share is over its natural share. All its documents are drawn,
and the other values of its dimension share what it lacks in proportion to their
targets.

Up to FEW cells are raked in one task; more are summed by partial aggregations,
and the sums of a value that many cells share are joined by salted keys.

Where no targets are given, a value's target is its share of the tokens to the
power ``alpha``, normalised: small sources, languages and topics gain.

Tokens are runs of other than ASCII white space. Documents carry no topic, so
unless ``topic`` gives one, topic is the layout of a text (``layout()``).

Defined cases: null, empty and blank texts have no tokens, weight and
probability 0 and are never drawn. Null sources, languages and topics are a
value of their own (``''``). Values that the given targets do not name keep
their natural share of what the named ones leave. Repeated rows and ids count
with all their tokens and are drawn together. Only doc_id, text, source, lang
are read; further columns are kept by ``sample`` and do not clash, but for a
column ``p_selected``, which the sample's own replaces. No rows give no rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.runtime import materialize

from . import common

DIMENSIONS = ("source", "lang", "topic")
MOST_SWEEPS = 400
TOLERANCE = 1e-12  # of a target share
ROUNDS = 12
STRETCH = 4  # sweeps in one plan
FEW = 100_000  # cells for one task


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def layout(text: Column, tokens: Column) -> Column:
    """caps, table, marked or prose: whether half of the letters a-z are upper
    case, a tenth of the tokens are bars, or there is a sign for each fourth."""
    full = F.coalesce(text, F.lit(""))
    count = lambda kind: F.length(full) - F.length(F.regexp_replace(full, f"[{kind}]+", ""))
    bars = F.length(full) - F.length(F.replace(full, F.lit("|"), F.lit("")))
    return F.when(count("A-Z") > count("a-z"), "caps").when(10 * bars > tokens, "table").when(4 * count("#$%&*!") > tokens, "marked").otherwise("prose")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform on [0, 1), the same for equal ids everywhere."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def with_sums(cells: DataFrame, d: str, few: bool, **what: Column) -> DataFrame:
    """Adds the sum of each of ``what`` over the cells that share their value of d."""
    if few:  # in one partition: no shuffle
        return cells.withColumns({k: F.sum(v).over(W.partitionBy(d)) for k, v in what.items()})
    sums = cells.groupBy(d).agg(*[F.sum(v).alias(k) for k, v in what.items()])
    return materialize(common.salted_join(cells, sums, d), "margins")


def kept_together(cells: DataFrame, few: bool) -> DataFrame:
    written = materialize(cells, "cells")
    return written.coalesce(1) if few else written


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float, sweeps: int = MOST_SWEEPS) -> tuple[DataFrame, bool, bool]:
    """Rakes to TOLERANCE, ``sweeps`` times at most. Adds ``w``, the raked share of
    each cell, ``m_d``, the tokens of its value of d, and ``g_d``, that value's
    target share; cells are (source, lang, topic, tokens) with tokens over 0. Says
    too whether the cells are few, and whether the targets are impossible."""
    cells = kept_together(cells, False)
    few = cells.count() <= FEW
    fitted = cells.coalesce(1) if few else cells
    for d in DIMENSIONS:
        fitted = with_sums(fitted, d, few, **{f"m_{d}": F.col("tokens").cast("double")})
    fitted = kept_together(fitted, few)
    goals, scale = {}, [F.sum("tokens").cast("double").alias("total")]
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        if given:
            named = F.col(d).isin(list(given))
            scale += [F.sum(F.when(named, F.lit(0)).otherwise(F.col("tokens"))).cast("double").alias(f"rest_{d}"), F.sum(F.when(named, _of(given, d) * F.col("tokens") / F.col(f"m_{d}")).otherwise(0.0)).alias(f"named_{d}")]
        else:
            scale.append(F.sum(F.col("tokens") / F.col(f"m_{d}") * F.pow(F.col(f"m_{d}"), F.lit(alpha))).alias(f"norm_{d}"))
    s = fitted.agg(*scale).first().asDict()
    if not s["total"]:
        return fitted.withColumns({"w": F.lit(0.0), **{f"g_{d}": F.lit(0.0) for d in DIMENSIONS}}), few, False
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        if given:
            left = max(0.0, 1.0 - s[f"named_{d}"]) if s[f"rest_{d}"] else 0.0
            goal = F.when(F.col(d).isin(list(given)), _of(given, d)).otherwise(F.col(f"m_{d}") * F.lit(left / s[f"rest_{d}"] if s[f"rest_{d}"] else 0.0))
            goals[d] = goal / F.lit(s[f"named_{d}"] + left)
        else:
            goals[d] = F.pow(F.col(f"m_{d}"), F.lit(alpha)) / F.lit(s[f"norm_{d}"])
    fitted = fitted.withColumns({"w": F.col("tokens") / F.lit(s["total"]), **{f"g_{d}": goals[d] for d in DIMENSIONS}})
    never = impossible(fitted)

    def sweep(fitted: DataFrame) -> DataFrame:
        for d in DIMENSIONS:
            raked = F.coalesce(F.try_divide(F.col("w") * F.col(f"g_{d}"), F.col("_sum")), F.lit(0.0))
            fitted = with_sums(fitted, d, few, _sum=F.col("w")).withColumn("w", raked).drop("_sum")
        return fitted

    def gap(fitted: DataFrame) -> float:
        gaps = [fitted.groupBy(d).agg(F.abs(F.sum("w") - F.max(f"g_{d}")).alias("gap")).select("gap") for d in DIMENSIONS]
        return gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] or 0.0

    return repeated(fitted, few, sweep, gap, sweeps, never), few, never


def repeated(cells: DataFrame, few: bool, sweep, gap, sweeps: int, never: bool) -> DataFrame:
    """Sweeps until the gap is within TOLERANCE, or ``sweeps`` are done, or, where
    it is known that the gap never closes, until it stands still."""
    done, left = 0, float("inf")
    while done < sweeps:
        for _ in range(min(STRETCH, sweeps - done)):
            cells = sweep(cells)
            done += 1
        cells = kept_together(cells, few)
        before, left = left, gap(cells)
        if left <= TOLERANCE or (never and left > 0.999 * before):
            break
    if left > TOLERANCE:
        what = "the target shares cannot all be met" if never else "the target shares are not met yet"
        warnings.warn(f"{what}: after {done} sweeps one is missed by {left:.3g}", stacklevel=3)
    return cells


def impossible(cells: DataFrame) -> bool:
    """Whether some value is to have more than all the values of another dimension
    that it occurs with."""
    lacking = []
    for d in DIMENSIONS:
        for e in DIMENSIONS:
            if d != e:
                met = cells.groupBy(d, e).agg(F.max(f"g_{d}").alias("own"), F.max(f"g_{e}").alias("other"))
                lacking.append(met.groupBy(d).agg((F.max("own") - F.sum("other")).alias("lack")).select("lack"))
    return (reduce(DataFrame.unionByName, lacking).agg(F.max("lack")).first()[0] or 0.0) > 1e-9


def bound(fitted: DataFrame, few: bool, never: bool, total: float, budget: float, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """Adds ``u``, raked so that the expected tokens least(tokens, u) of each
    value are its target, or all it has. Raised values take a Newton step: what
    full cells cannot give comes from the others."""
    size = dict.fromkeys(DIMENSIONS, budget * total)  # tokens for a target share of 1, full values aside
    for _ in range(ROUNDS):
        full = {d: F.col(f"g_{d}") * size[d] >= F.col(f"m_{d}") for d in DIMENSIONS}
        of_value = {d: F.col("tokens") / F.col(f"m_{d}") for d in DIMENSIONS}
        s = fitted.agg(
            *[F.sum(F.when(full[d], F.col("tokens")).otherwise(F.lit(0))).cast("double").alias(f"full_{d}") for d in DIMENSIONS],
            *[F.sum(F.when(full[d], F.lit(0.0)).otherwise(F.col(f"g_{d}") * of_value[d])).alias(f"rest_{d}") for d in DIMENSIONS],
        ).first()
        better = {d: max(size[d], (budget * total - s[f"full_{d}"]) / s[f"rest_{d}"]) if s[f"rest_{d}"] > 1e-12 else size[d] for d in DIMENSIONS}
        if all(better[d] <= size[d] * (1 + 1e-12) for d in DIMENSIONS):
            break
        size = better
    goal = {d: F.least(F.col(f"m_{d}"), F.col(f"g_{d}") * size[d]) for d in DIMENSIONS}
    sums = {"_all": F.least(F.col("tokens").cast("double"), F.col("u")), "_full": F.when(F.col("u") >= F.col("tokens"), F.col("tokens").cast("double")).otherwise(F.lit(0.0))}

    def sweep(raked: DataFrame) -> DataFrame:
        for d in DIMENSIONS:
            free = F.col("_all") - F.col("_full")
            step = F.when(goal[d] < F.col("_all"), goal[d] / F.col("_all")).when(free > F.lit(1e-12 * total), (goal[d] - F.col("_full")) / free).otherwise(1.0)
            raked = with_sums(raked, d, few, **sums).withColumn("u", F.col("u") * step).drop("_all", "_full")
        return raked

    def gap(raked: DataFrame) -> float:
        gaps = [raked.groupBy(d).agg(F.abs(F.sum(sums["_all"]) - F.max(goal[d])).alias("gap")).select("gap") for d in DIMENSIONS]
        return (gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] or 0.0) / (budget * total)

    return repeated(fitted.withColumn("u", F.col("w") * F.lit(budget * total)), few, sweep, gap, sweeps, never)


def _of(given: dict[str, float], d: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(d)), F.lit(0.0))


def plan(docs: DataFrame, keep: list[str], targets=None, budget: float = 0.5, alpha: float = 0.7, sweeps: int = MOST_SWEEPS, topic=layout) -> tuple[DataFrame, DataFrame]:
    """The documents with their cell (columns row, source, lang, topic,
    n_tokens; row has the columns ``keep``) and the cells with weight and
    probability. Texts are looked at once: the first result is written."""
    named = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    keyed = docs.select(named, F.col("text").alias("_text"), n_tokens(F.col("text")).alias("n_tokens"), *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in ("source", "lang")])
    keyed = materialize(keyed.withColumn("topic", F.coalesce(topic(F.col("_text"), F.col("n_tokens")), F.lit(""))).drop("_text"), "cells-of-rows")
    cells = keyed.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    fitted, few, never = rake(cells, targets, alpha, sweeps)
    total = fitted.agg(F.sum("tokens")).first()[0]
    if not total:
        return keyed, fitted.withColumn("weight", F.lit(0.0)).withColumn("probability", F.lit(0.0))
    fitted = bound(fitted.withColumn("weight", F.col("w") * F.lit(float(total)) / F.col("tokens")), few, never, float(total), budget, sweeps)
    return keyed, fitted.withColumn("probability", F.least(F.lit(1.0), F.col("u") / F.col("tokens")))


def calibrated(docs: DataFrame, keep: list[str] | None = None, seed: int = 42, **how) -> DataFrame:
    """row (the columns ``keep``, doc_id at least), source, lang, topic,
    n_tokens, weight, probability and selected of every document."""
    keyed, cells = plan(docs, keep or ["doc_id"], **how)
    cells = cells.select(*DIMENSIONS, "weight", "probability")
    joined = keyed.join(cells, list(DIMENSIONS), "left")
    some = F.col("n_tokens") > 0
    joined = joined.withColumns({c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("weight", "probability")})
    return joined.withColumn("selected", draw(F.col("row.doc_id"), seed) < F.col("probability"))


def sample(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The drawn documents as they are, with their probability in ``p_selected``."""
    drawn = calibrated(docs, docs.columns, seed, **how).where("selected")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "p_selected"]
    return drawn.select(*kept, F.col("probability").alias("p_selected"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document, with the default targets.
    The cases are those of the module."""
    drawn = calibrated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def oracle(budget: float = 0.5, alpha: float = 0.7, sweeps: int = MOST_SWEEPS, rounds: int = ROUNDS, seed: int = 42) -> str:
    """The same for DuckDB: sweeps as recursion, all of them."""
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    cells = "source, lang, topic, tokens, total, " + ", ".join(f"{x}_{d}" for d in DIMENSIONS for x in "mg")
    raked = "r"
    for d in DIMENSIONS:
        raked = f"(SELECT * REPLACE (w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {raked})"
    bounded = "b"
    for d in DIMENSIONS:
        summed = f"(SELECT *, sum(least(tokens, u)) OVER (PARTITION BY {d}) AS a, sum(CASE WHEN u >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS f FROM {bounded})"
        bounded = f"(SELECT * EXCLUDE (a, f) REPLACE (u * CASE WHEN t_{d} < a THEN t_{d} / a WHEN a - f > 1e-12 * total THEN (t_{d} - f) / (a - f) ELSE 1 END AS u) FROM {summed})"
    goals = ", ".join(f"t_{d}" for d in DIMENSIONS)
    full = lambda d: f"g_{d} * size_{d} >= m_{d}"
    steps = [
        f"""d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)""",
        f"""k AS (SELECT doc_id, source, lang, t, {count("[^ \t\n\x0B\f\r]+")} AS n_tokens FROM d)""",
        f"""e AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN {count("[A-Z]")} > {count("[a-z]")} THEN 'caps' WHEN 10 * (length(t) - length(replace(t, '|', ''))) > n_tokens THEN 'table'
             WHEN 4 * {count("[#$%&*!]")} > n_tokens THEN 'marked' ELSE 'prose' END AS topic FROM k)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e WHERE n_tokens > 0 GROUP BY ALL)",
        "m AS (SELECT *, sum(tokens) OVER (PARTITION BY source) AS m_source, sum(tokens) OVER (PARTITION BY lang) AS m_lang, sum(tokens) OVER (PARTITION BY topic) AS m_topic FROM c)",
        "z AS (SELECT sum(tokens) AS total, " + ", ".join(f"sum(tokens / m_{d} * pow(m_{d}, {alpha})) AS z_{d}" for d in DIMENSIONS) + " FROM m)",
        "g AS MATERIALIZED (SELECT m.*, total, " + ", ".join(f"pow(m_{d}, {alpha}) / z_{d} AS g_{d}" for d in DIMENSIONS) + " FROM m, z)",
        f"r AS (SELECT 0 AS i, {cells}, tokens / total AS w FROM g UNION ALL SELECT i + 1, {cells}, w FROM {raked} WHERE i < {sweeps})",
        f"f AS MATERIALIZED (SELECT {cells}, w, w * total / tokens AS weight FROM r WHERE i = {sweeps})",
        "s0 AS MATERIALIZED (SELECT " + ", ".join(f"{budget} * max(total) AS size_{d}" for d in DIMENSIONS) + " FROM f)",
    ]
    for n in range(rounds):
        better = ", ".join(f"greatest(size_{d}, coalesce(CASE WHEN sum(CASE WHEN {full(d)} THEN 0 ELSE g_{d} * tokens / m_{d} END) > 1e-12 THEN ({budget} * max(total) - sum(CASE WHEN {full(d)} THEN tokens ELSE 0 END)) / sum(CASE WHEN {full(d)} THEN 0 ELSE g_{d} * tokens / m_{d} END) END, size_{d})) AS size_{d}" for d in DIMENSIONS)
        steps.append(f"s{n + 1} AS MATERIALIZED (SELECT {better} FROM f, s{n} GROUP BY " + ", ".join(f"size_{d}" for d in DIMENSIONS) + ")")
    targets = ", ".join(f"least(m_{d}, g_{d} * size_{d}) AS t_{d}" for d in DIMENSIONS)
    steps += [
        f"b AS (SELECT 0 AS i, source, lang, topic, tokens, total, weight, {targets}, w * {budget} * total AS u FROM f, s{rounds} UNION ALL SELECT i + 1, source, lang, topic, tokens, total, weight, {goals}, u FROM {bounded} WHERE i < {sweeps})",
        f"p AS (SELECT source, lang, topic, weight, least(1.0, u / tokens) AS probability FROM b WHERE i = {sweeps})",
    ]
    return (
        "WITH RECURSIVE "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, e.source AS source, e.lang AS lang, e.topic AS topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(CASE WHEN n_tokens > 0 THEN weight ELSE 0 END, 6) AS weight, round(CASE WHEN n_tokens > 0 THEN probability ELSE 0 END, 6) AS probability,
       CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < CASE WHEN n_tokens > 0 THEN probability ELSE 0 END AS selected
FROM e LEFT JOIN p USING (source, lang, topic)"""
    )
