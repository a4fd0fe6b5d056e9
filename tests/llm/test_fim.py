import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import fim as M

from . import samples

PATTERNS = {M.LINES: r"[^\n]*\n|[^\n]+", M.WORDS: r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", M.CHARACTERS: r"[\s\S]"}


def plain(doc_id, text, unit=M.LINES, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    n, d = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in M.MARKS) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = ["a\nb\nc", "a\n\n\nb\n", "\n", "x\r\ny\rz", "one <P> two", "<S>", "ends in <M>", "<", "<P", "P>\n<\nS>", "\x01\n\x02\n\x021\x011\x022", "\x01" * 9, "$0\n\\1\n$", "🙂\n日本\né\n", " \n\x85\n\x0b\n", "a\n" * 5000, "no end " * 20000]


@pytest.mark.parametrize("how", [{}, {"rate": 30, "spm": 80, "seed": 1}, {"unit": M.WORDS}, {"unit": M.CHARACTERS}])
def test_against_lists(spark, how):
    rows = [*samples.AWKWARD, *[(100 + i, t) for i, t in enumerate(TEXTS)], *[(1000 + i, f"l{i}\nm\n\nn{i}") for i in range(200)], *[(1 << 62, t) for t in TEXTS]]
    df = samples.docs(spark, rows)
    made = M.transformed(df.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)), **how).withColumn("again", M.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.select("doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars", "again").collect()]
    want = [(k, t or "", *plain(k, t, **how), t or "") for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows_and_no_shuffle(spark):
    none = M.transformed(samples.docs(spark, samples.AWKWARD).where("false"))
    assert none.count() == 0
    assert "Exchange" not in none._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a\n<PSM>\x01\x0212 é", max_size=40), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = M.transformed(df).withColumn("again", M.restored(F.col("output"), F.col("form"))).orderBy("doc_id").collect()
    assert [r.again for r in made] == texts
    assert [(r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in made] == [plain(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("<P>", "<S<", "<M>")])
def test_marks_that_overlap(marks):
    with pytest.raises(ValueError):
        M.checked(marks)
