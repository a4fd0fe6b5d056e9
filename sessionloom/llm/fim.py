"""Fill-in-the-middle transformation of texts by escaped markers.

A text is cut into units. A control character is appended after each unit, its
own occurrences in the text escaped before; the units are then ranked parts of
one string: counting the character counts them, ``substring_index`` takes the
first or last of them. Prefix, middle and suffix are unescaped and put together
with the marks ``<P>``, ``<S>`` and ``<M>``. Everything is a column expression;
rows are transformed where they are, without a shuffle.

The two cuts, whether a text is transformed and which form it gets follow from the
SHA-256 of the seed and the row's id, so they are the same in every run, whatever
the partitioning.

Defined cases: null texts count as empty ones. A text is left as it is (form
``plain``, no character counts) if it is empty, holds one of the marks, or is not
among the ``rate`` of 100 that are drawn. A null id counts as an empty one, so
all such rows share their draw; repeated ids share theirs too, and repeated rows
are transformed each. Control characters in a text are kept. Columns other than
doc_id and text are not read. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
AFTER, ESCAPE = "\u0001", "\u0002"  # the character after each unit, and the one that escapes both

# patterns of units; they are matched on the escaped text
LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"\s*\S+|\s+"
CHARACTERS = rf"{ESCAPE}[12]|[\s\S]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(AFTER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(AFTER)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def ranked(marked: str, count: Column) -> Column:
    """The first ``count`` parts of a marked text, or for a negative count the last."""
    return F.call_function("substring_index", F.col(marked), F.lit(AFTER), count.cast("int"))


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that no text without them can make together with another mark:
    the first character of each comes nowhere else in any."""
    heads = {m[:1] for m in marks}
    if len(set(marks)) < 3 or "" in marks or any(c in m[1:] for m in marks for c in heads):
        raise ValueError("marks have to differ, and their first characters must not come again in them")
    return marks


def transformed(docs: DataFrame, unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text (null as empty), n (its units), form, output, and the
    characters of prefix and middle, null where the form is plain.

    ``unit`` is the pattern of a unit, whose matches have to cover every text.
    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these suffix first."""
    prefix, suffix, middle = (F.lit(m) for m in checked(marks))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = lambda i: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long")
    # each step is a projection of its own, as later ones use its columns more than once
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.sha2(key.cast("binary"), 256).alias("_digest"))
    whole = whole.withColumn("_escaped", escaped(F.col("text")))
    whole = whole.withColumn("_marked", F.regexp_replace("_escaped", unit, "$0" + AFTER))
    whole = whole.withColumn("n", (F.octet_length("_marked") - F.octet_length("_escaped")).cast("long"))
    cuts = [draw(i) % (F.col("n") + 1) for i in (0, 1)]
    whole = whole.withColumns({"_from": F.least(*cuts), "_to": F.greatest(*cuts)})
    held = F.contains("text", prefix) | F.contains("text", suffix) | F.contains("text", middle)
    whole = whole.withColumn("form", F.when((F.col("text") == "") | held | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm"))
    whole = whole.withColumn("_head", ranked("_marked", F.col("_to")))
    # behind the last unit comes an empty part: the last k units are the last k + 1 parts
    parts = {"_prefix": ranked("_marked", F.col("_from")), "_middle": ranked("_head", F.col("_from") - F.col("_to")), "_suffix": ranked("_marked", F.col("_to") - F.col("n") - 1)}
    whole = whole.withColumns({k: unescaped(F.replace(v, F.lit(AFTER), F.lit(""))) for k, v in parts.items()})
    plain = F.col("form") == "plain"
    first = F.when(F.col("form") == "psm", F.concat(prefix, "_prefix", suffix, "_suffix")).otherwise(F.concat(suffix, "_suffix", prefix, "_prefix"))
    chars = lambda c: F.when(~plain, F.length(c).cast("long"))
    return whole.select(
        "doc_id", "text", "n", "form", F.when(plain, F.col("text")).otherwise(F.concat(first, middle, "_middle")).alias("output"), chars("_prefix").alias("prefix_chars"), chars("_middle").alias("middle_chars")
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from."""
    prefix, suffix, middle = marks
    head, last = F.substring_index(output, middle, 1), F.substring_index(output, middle, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, suffix, 1), prefix, -1), last, F.substring_index(head, suffix, -1))
    spm = F.concat(F.substring_index(head, prefix, -1), last, F.substring_index(F.substring_index(head, prefix, 1), suffix, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document in its form, lines as units: counts and digests. The cases
    are those of ``transformed``."""
    made = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
