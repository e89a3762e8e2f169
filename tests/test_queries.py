"""Every core query against its SQL, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cadenza.plans import queries as core


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return sorted(str([clean(r[i]) for i in order]) for r in values), sorted(columns)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = core.QUERIES[name](spark, data)
    out = duck.execute(core.ORACLE_SQL[name])
    want = rows([c[0] for c in out.description], out.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["piece_id", "time", "beat", "downbeat"] and df.count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())
