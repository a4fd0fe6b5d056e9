"""Every query of the engine against its DuckDB statement, and against itself
with another number of partitions."""

import datetime as dt
import math

import duckdb
import pytest

from sessionloom.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


def rows(found):
    return sorted(repr(tuple(map(plain, r))) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want)


@pytest.mark.parametrize("name", ["context_cumulative", "tool_call_upsert", "session_upsert", "lineage_score", "gate_decisions", "before_stop", "search", "parity_sessions"])
def test_partitions_do_not_matter(spark, sf, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append(rows(tuple(r) for r in QUERIES[name](spark, sf).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_every_query_runs_or_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
