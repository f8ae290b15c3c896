"""Every query against its SQL on the smallest data."""

import pytest

from compare import of_duck, of_spark
from conftest import DATA
from docmill.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert of_spark(plans.queries()[name](spark, DATA)) == of_duck(duck, plans.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
