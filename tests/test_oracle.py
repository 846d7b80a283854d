"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, connect
from tests.conftest import SMALL

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    verdict = compare(spark, duck, SMALL, name, queries()[name], oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows")), verdict


def test_entry(spark):
    assert entry(spark).count() == 1


def test_oracle_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
