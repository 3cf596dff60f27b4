"""Every registered query against its oracle; the others run and give rows."""

from __future__ import annotations

import pytest

from driftfield.plans import catalogue
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
