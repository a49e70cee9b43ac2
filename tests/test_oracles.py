"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, con, name):
    df = QUERIES[name](spark, small_dir)
    if name in ORACLES:
        rows, inexact, error = compare(df, con, ORACLES[name])
        assert error is None, error
    else:
        df.write.format("noop").mode("overwrite").save()


def test_flagship_has_rows(spark, small_dir):
    assert entry.entry(spark).count() > 0
