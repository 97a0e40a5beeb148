"""Every registered query that has SQL, against it."""

import os

import pytest

import checker
from lucidform.plans import registry

registry.load_all()
SF = os.environ.get("LUCIDFORM_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return checker.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert checker.compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name], tol=1e-9) == []


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
