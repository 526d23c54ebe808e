"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

from normlake.plans import load_all
from normlake.plans.registry import REGISTRY

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    entry = REGISTRY[name]
    ok, detail = compare(spark, con, entry, SF_DIR, allow_empty=True)
    assert ok, detail


def test_contract():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
