"""Every registered query that is no part of the training-data operators, against its SQL."""

import pytest
from compare import connect, rows_of, sql_rows

from ledgerloom.jobs import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, rows = rows_of(df)
    if name in SQL:
        assert (columns, rows) == sql_rows(con, SQL[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["qid", "n_rows", "n_unique", "decision", "answer", "tier"]
