"""Every registered query against its DuckDB twin on the smallest scale."""

import pytest

from quire.plans import check
from quire.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES = queries()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check.compare(spark, name, QUERIES[name], ORACLE.get(name), SF, con)
    if name in ORACLE:
        assert res["ok"], res.get("why")
    else:
        assert res["rows"] >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
