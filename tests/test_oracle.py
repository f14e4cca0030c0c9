"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest
from compare import differences

from gleanery.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    only_spark, only_sql, n = differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
    assert not only_spark and not only_sql, (list(only_spark.items())[:5], list(only_sql.items())[:5])
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
