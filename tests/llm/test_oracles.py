import os

import pytest

from tests.oracle import compare, connect
from tracewright.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    compare(got, connect(SF).execute(queries.oracle_sql()[name]).df())
