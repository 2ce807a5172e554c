"""Every registered query against its SQL, value for value."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tests.oracle import compare, connect


# Queries of the training-data operators are tested beside them.
NAMES = [name for name in entry.queries() if not name.startswith("op") and name != "pipeline"]


def test_every_query_has_sql():
    assert set(NAMES) <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name, scale):
    folder = f"{DATA}/sf{scale}"
    con = connect(folder)
    assert compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])[:3] == []


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["threshold", "saved_pct_a05", "saved_pct_a10", "saved_pct_a15",
                             "saved_pct_a20", "avg_chunks"]
    assert frame.count() == 6
