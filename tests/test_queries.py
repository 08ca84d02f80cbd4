"""Every registered query against its SQL on the smallest tables."""

import pytest

from kelpline.plans import registry
from tests.compare import agree, duck

NAMES = sorted(registry.queries())


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, small, name):
    agree(registry.queries()[name](spark, small), duck(small), registry.oracle_sql()[name])


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
