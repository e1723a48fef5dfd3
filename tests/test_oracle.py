"""Every registered query against its SQL, or at least that it runs."""

import oracle
import pytest

from verdigris.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    found = registry.queries()[name](spark, sf_dir)
    if name in SQL:
        oracle.same(con, found, SQL[name])
    else:
        assert found.count() >= 0
