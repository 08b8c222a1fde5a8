"""Every registered query against its SQL on whole small tables; the others must run and keep their invariants."""

import pytest

from compare import connect, differences
from sievework import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, tiny, name):
    assert differences(spark, con, QUERIES[name], SQL[name], tiny) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"m01_bow_predictability"}))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).collect()
