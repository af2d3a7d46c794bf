import os

import pytest

from scriptoria import catalog
from tests.oracle import of_spark, of_sql

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_same_as_sql(spark, name):
    assert of_spark(catalog.queries()[name](spark, SMALL)) == of_sql(catalog.sql()[name], SMALL)


@pytest.mark.parametrize("name", ["segments__P17", "kmeans__M1", "probe_table__R11_A17"])
def test_twice_the_same(spark, name):
    q = catalog.queries()[name]
    first = of_spark(q(spark, SMALL))
    assert first[1] and first == of_spark(q(spark, SMALL))
