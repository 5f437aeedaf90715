"""Every core query with SQL against DuckDB on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import problems, reference, stored, views
from tools.verify import norm

DATA = Path("/root/testdata/sf0.001")
QUERIES = {**reference.QUERIES, **views.QUERIES, **stored.QUERIES, **problems.QUERIES}
ORACLES = {**reference.ORACLES, **views.ORACLES, **stored.ORACLES, **problems.ORACLES}


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    assert {f"p{n}_found" for n in range(1, 8)} <= set(qs)
    if DATA.exists():
        assert entry.entry(spark).count() == 14
