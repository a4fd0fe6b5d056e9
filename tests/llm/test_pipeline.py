import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sessionloom.llm import simhash

from . import samples


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.cache()
        if k < 4:
            assert made.columns == columns, name
        assert 0 < made.count() <= rows
        docs, rows = made, made.count()
    assert docs.where("text LIKE '%token = \"%' AND NOT text LIKE '%<SECRET>%'").count() == 0


def test_run_keeps_one_of_each_group(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    found = simhash.near_duplicates(out)
    assert found.where("doc_id <> component_id").count() <= out.where("text LIKE '%<SECRET>%'").count()
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0
    assert out.where(F.col("p_selected") <= 0).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_rows(spark, sf, k):
    """Null, repeated and clashing things; a text of a million words."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = [*samples.AWKWARD, (11, samples.prose(1000, 5) + " " + "word " * 1_000_000), (None, None), (12, samples.prose(60, 6)), (12, samples.prose(60, 7))]
    docs = samples.docs(spark, rows).withColumn("p_selected", F.lit(9.0)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    made = stage(spark, docs, sf)
    assert sorted(made.columns) == sorted(docs.columns), name
    out = made.collect()
    before, after = Counter((r.doc_id, r.text) for r in docs.collect()), Counter((r.doc_id, r.text) for r in out)
    assert after <= before, name  # nothing here is a secret
    if name == "SimHash near-dedup":
        assert after[9, samples.prose(40, 2)] == 1 and sum(n for (_, t), n in after.items() if not (t or "").strip()) == 1
    elif name == "mixing sources to target weights":
        assert not any(not (t or "").strip() for _, t in after) and all(0 < r.p_selected <= 1 for r in out)
    elif name != "quality classifier":
        assert after == before, name
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_registered():
    names = [*__spark_entry__.queries()]
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_oracles(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_entry_module_reloads():
    importlib.reload(__spark_entry__)
