import os

import pytest

from tracewright import plans
from tracewright.sources import scratch

from .oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.SQL:
        compare(got, con.execute(plans.SQL[name]).df())
    assert len(got) > 0
    scratch.clear(spark)
