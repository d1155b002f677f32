"""Every query of the scanner against its SQL."""

import pytest

from coderake.queries import Q, SQL
from tests.conftest import DATA
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q))
def test_query_matches_sql(spark, name):
    same(Q[name](spark, DATA).toPandas(), SQL[name], DATA)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
