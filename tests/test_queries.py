"""Every registered query of the matrix engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tesserae.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    show = lambda v: "nan" if v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_equals_sql(spark, sql, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(sql.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
