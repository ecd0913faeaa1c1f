"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import duck, rows

import trendmill.queries  # noqa: F401
from trendmill import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    want = duck(FOLDER, registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
