"""Every query of the library runs and equals its SQL."""

import pytest

from sparkthrift import catalog

from .oracle import check


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, name):
    frame = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        check(frame, sql, sf_dir)
    assert len(frame)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
