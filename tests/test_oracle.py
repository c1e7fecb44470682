"""Every query of the catalogue (all have an oracle) against its DuckDB oracle (small scale factor)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from mailspark.plans import catalog
from tools.check_oracle import TABLES, TYPE_MAP, rows_of

SF_SMALL = os.environ.get("MAILSPARK_ORACLE_SF", "/root/testdata/sf0.001")
ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    dtypes = dict(zip(dcols, [str(t) for t in duck.sql(ORACLE[name]).types]))
    assert [(c, TYPE_MAP.get(t, t)) for c, t in df.dtypes] == [(c, dtypes[c]) for c, _ in df.dtypes]
    assert rows_of(df.columns, rows) == rows_of(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
