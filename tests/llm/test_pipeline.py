"""The pipeline and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cadenza.llm import registry

from .helpers import ODD, documents


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def same(df, out):
    names = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(str([tidy(r[c]) for c in names]) for r in df.collect())
    cols = [c[0] for c in out.description]
    assert sorted(cols) == names
    assert got == sorted(str([tidy(r[cols.index(c)]) for c in names]) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    same(registry.QUERIES[name](spark, data), duck.execute(registry.ORACLE_SQL[name]))


def test_pipeline_equals_sql(spark, data, duck):
    same(corpus_pipeline.run(spark, data), duck.execute(corpus_pipeline.ORACLE_SQL))


def test_all_are_registered():
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in registry.QUERIES}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("rows", [0, len(ODD)])
def test_stages_take_odd_tables(spark, data, rows):
    from pyspark.sql import functions as F

    docs = documents(spark, ODD).limit(rows).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        assert out.count() <= rows
