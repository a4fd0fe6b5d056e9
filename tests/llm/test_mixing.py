import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import mixing as M

from .samples import AWKWARD, docs, prose

ROWS = [(i, prose(5 + i % 37, i), ["en", "de", None][i % 3 if i % 5 else 0], f"s{i % 4 if i % 3 else 0}") for i in range(300)]


def test_marginals_hold(spark):
    d = docs(spark, ROWS)
    _, cells = M.plan(d, ["doc_id"])
    cells = cells.collect()
    total = sum(c.tokens for c in cells)
    for dim in M.DIMENSIONS:
        natural, raked = defaultdict(float), defaultdict(float)
        for c in cells:
            natural[c[dim]] += c.tokens / total
            raked[c[dim]] += c.w
        norm = sum(v**0.7 for v in natural.values())
        assert all(math.isclose(raked[k], v**0.7 / norm, rel_tol=1e-6) for k, v in natural.items())
    assert math.isclose(sum(c.tokens * c.probability for c in cells), total / 2, rel_tol=1e-6)
    assert all(0 < c.probability <= 1 for c in cells)


def test_given_targets(spark):
    _, cells = M.plan(docs(spark, ROWS), ["doc_id"], targets={"lang": {"en": 0.2, "de": 0.6}})
    by = defaultdict(float)
    for c in cells.collect():
        by[c.lang] += c.w
    assert math.isclose(by["de"], 0.6, rel_tol=1e-6) and math.isclose(by["en"], 0.2, rel_tol=1e-6) and math.isclose(by[""], 0.2, rel_tol=1e-6)


def test_awkward_rows_and_draws(spark):
    d = docs(spark, [*AWKWARD, *ROWS])
    got = M.calibrated(d).select("row.doc_id", "n_tokens", "probability", "selected", "topic").collect()
    assert len(got) == d.count()
    assert all(r.probability == 0 and not r.selected for r in got if r.n_tokens == 0)
    assert len({r.selected for r in got if r.doc_id == 9}) == 1
    drawn = M.sample(d)
    assert drawn.columns == [*d.columns, "p_selected"]
    assert drawn.count() == sum(r.selected for r in got)
    assert M.sample(d.where("false")).count() == 0 and M.calibrated(d.where("length(trim(text)) = 0")).where("selected").count() == 0


@pytest.mark.parametrize(("text", "topic"), [(None, "prose"), ("ABC DEF g", "caps"), ("a | b | c", "table"), ("ab!! cd## ef$", "marked"), ("plain words only, here", "prose")])
def test_layout(spark, text, topic):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.layout(F.col("t"), M.n_tokens(F.col("t")))).first()[0] == topic


def test_draw_is_uniform(spark):
    u = [r[0] for r in spark.range(4000).select(M.draw(F.col("id"), 42)).collect()]
    assert all(0 <= x < 1 for x in u) and abs(sum(u) / len(u) - 0.5) < 0.02


def _reached(cells, budget=0.5):
    """By dimension and value: expected tokens, target, and all tokens there are;
    what a value lacks is shared by the others in proportion to their targets."""
    total, out = sum(c.tokens for c in cells), {}
    for dim in M.DIMENSIONS:
        expected, natural = defaultdict(float), defaultdict(float)
        for c in cells:
            expected[c[dim]] += c.tokens * c.probability
            natural[c[dim]] += c.tokens
        share = {k: (v / total) ** 0.7 for k, v in natural.items()}
        full = set()
        while True:
            left = (budget * total - sum(natural[k] for k in full)) / sum(v for k, v in share.items() if k not in full)
            more = {k for k in share if k not in full and share[k] * left > natural[k]}
            if not more:
                break
            full |= more
        out |= {(dim, k): (expected[k], natural[k] if k in full else share[k] * left, natural[k]) for k in natural}
    return out


def test_the_sample_meets_the_targets(spark, sf):
    _, cells = M.plan(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), ["doc_id"])
    cells = cells.collect()
    reached = _reached(cells)
    assert all(c.probability <= 1 for c in cells) and any(math.isclose(want, most) for _, want, most in reached.values())
    for key, (got, want, _) in reached.items():
        assert math.isclose(got, want, rel_tol=1e-3), key


def test_a_value_beyond_its_target_is_taken_whole(spark):
    rows = [(i, prose(20, i), "en" if i % 10 else "de", "big" if i % 40 else "small") for i in range(800)]
    _, cells = M.plan(docs(spark, rows), ["doc_id"], targets={"source": {"small": 0.5}})
    for c in cells.collect():
        assert c.source == "big" or math.isclose(c.probability, 1)


def test_targets_that_cannot_be_met_together(spark):
    rows = [(i, prose(20, i), "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(100)]  # all of a is en
    with pytest.warns(UserWarning, match="cannot all be met"):
        M.rake(cells_of(spark, {("a", "en"): 10, ("b", "de"): 30}), {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}}, 0.7)
    with pytest.warns(UserWarning, match="cannot all be met"):
        assert M.calibrated(docs(spark, rows), targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "de": 0.8}}).count() == 100


def cells_of(spark, tokens):
    return spark.createDataFrame([(*k, "prose", v) for k, v in tokens.items()], "source string, lang string, topic string, tokens long")


NEARLY_DIAGONAL = {("a", "x"): 10**6, ("b", "y"): 10**6, ("a", "y"): 1, ("b", "x"): 1}


def test_targets_that_are_met_slowly(spark):
    fitted, _, never = M.rake(cells_of(spark, NEARLY_DIAGONAL), {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}}, 0.7)
    w = {(r.source, r.lang): r.w for r in fitted.collect()}
    assert not never and math.isclose(w["a", "x"] + w["a", "y"], 0.6, rel_tol=1e-9) and math.isclose(w["a", "x"] + w["b", "x"], 0.5, rel_tol=1e-9)


def test_not_met_yet_is_said(spark):
    with pytest.warns(UserWarning, match="not met yet"):
        M.rake(cells_of(spark, NEARLY_DIAGONAL), {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}}, 0.7, sweeps=3)


def test_many_cells_give_the_same(spark, monkeypatch):
    d = docs(spark, ROWS[:120])
    one = {(c.source, c.lang, c.topic): c.probability for c in M.plan(d, ["doc_id"])[1].collect()}
    monkeypatch.setattr(M, "FEW", 0)
    monkeypatch.setattr(M, "STRETCH", 2)
    many = {(c.source, c.lang, c.topic): c.probability for c in M.plan(d, ["doc_id"], sweeps=20)[1].collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-6) for k in one)
