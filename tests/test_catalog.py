"""Every registered graph query against its SQL at the smallest scale."""

import glob
import os

import pytest

from hoplite.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    table = lambda df: sorted(map(tuple, df[columns].convert_dtypes().astype(str).to_numpy().tolist()))
    assert table(got) == table(expected)


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).first()["count"] == 24
