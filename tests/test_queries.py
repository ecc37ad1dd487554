"""Every query with SQL agrees with it on the given tables; the others give rows."""

from __future__ import annotations

import pytest
from check_queries import ROOT, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = f"{ROOT}/sf0.01"
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, name, queries()[name], CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(CHECKS)))
def test_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(queries())
