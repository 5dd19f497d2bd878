"""Every query with an oracle equals DuckDB on the same tables (small scale)."""

import pytest

import __spark_entry__ as E
from verification.compare import compare, duck, to_pandas

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, sf_dir, con, name):
    got = to_pandas(E.queries()[name](spark, sf_dir))
    exp = con.sql(SQL[name]).df()
    ok, msg = compare(got, exp, rel=1e-9)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_has_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [r.CLV_quartile for r in rows] == ["Low", "Medium", "High", "Premium"]
    assert sum(r.total for r in rows if r.total is not None) > 0
