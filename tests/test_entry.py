import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 55


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() == 200
