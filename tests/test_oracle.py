"""Every registered query against its DuckDB oracle (sf0.001), plus the driver contract."""

import duckdb
import pytest

from tickwise.plans.registry import ORACLES, QUERIES, load_all
from tickwise.sources.tables import TABLES

from .conftest import SF_SMALL

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(rows, cols):
    import sys

    sys.path.insert(0, "tools")
    from tools.oracle_check import digest

    return digest(cols, rows)[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(srows, df.columns) == _canon(drows, dcols)


def test_entry_contract(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
