"""Each query of the transit library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from headway import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.environ.get('QUERY_SF', SF)}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(float(r[k]), 6) if isinstance(r[k], (float, int)) and not isinstance(r[k], bool) else str(r[k]) for k in order) for r in map(tuple, data)), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, os.environ.get("QUERY_SF", SF))
    got, columns = rows(df.columns, df.collect())
    r = oracle.execute(catalog.ORACLES[name])
    want, expected = rows([d[0] for d in r.description], r.fetchall())
    assert columns == expected
    assert got == want
    assert want


def test_without_sql(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).count() > 0
