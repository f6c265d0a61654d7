"""Every query against its SQL twin on the smallest tables; queries without a twin must give rows of a stable schema."""

import decimal
import math

import duckdb
import pytest

from quernstone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def show(v):
        """Integers as they are, whole floats too; other floats at nine digits, as sums differ in their last ones."""
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if isinstance(v, (int, float, decimal.Decimal)):
            return str(int(v)) if math.isfinite(v) and v == int(v) else f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got and df.columns
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(got, df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id_a", "id_b", "similarity"]
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())
