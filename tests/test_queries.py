"""Every registered query with SQL equals it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from decoyscope.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for k in pdf.columns:
        pdf[k] = pdf[k].map(lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(map(tuple, pdf.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
