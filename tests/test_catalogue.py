"""Every query runs, and gives the rows of its SQL where it has one."""

import pytest
from conftest import same_rows

from tabweave.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    frame = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.SQL:
        same_rows(frame, duck.sql(catalogue.SQL[name]).df())
    else:
        assert len(frame)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
