"""Every query of the catalogue gives the rows of its SQL."""

import decimal

import duckdb
import pytest

from ledgermill.plans import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


def plain(v):
    return f"{float(v):.6f}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
