"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from compare import oracle, rows

from sparsefold.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert rows(found) == oracle(ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
