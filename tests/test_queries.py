import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"
#: The smallest tables have too few labelled rows for a split, so nothing is attributed there.
LARGER = {"attrib_tree": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, name):
    status, rows, _ = compare(spark, LARGER.get(name, SF), name)
    assert status in ("ok", "rows only"), status
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
