"""Every query of the core against its SQL."""

import pytest

from conftest import SMALL
from parity import database, rows
from sufragio.plans import extended, problems, queries


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", [*queries.QUERIES, *extended.QUERIES, *problems.QUERIES])
def test_query_equals_sql(spark, db, name):
    every, sql = {**queries.QUERIES, **extended.QUERIES, **problems.QUERIES}, {**queries.ORACLE, **extended.ORACLE, **problems.ORACLE}
    got, want = every[name](spark, SMALL).toPandas(), db.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_all_core_queries(spark):
    import __spark_entry__ as e

    assert {*queries.QUERIES, *extended.QUERIES, *problems.QUERIES} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
