import pytest

import __spark_entry__ as entry
from tarnlake.plans.catalogue import ORACLES, QUERIES

from .oracle import rows_of, sql_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == sql_rows(ORACLES[name], SMALL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
