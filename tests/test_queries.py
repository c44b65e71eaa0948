import pytest

from quire.plans import queries
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    run, sql = queries.QUERIES[name], queries.SQL.get(name)
    if sql is None:
        assert run(spark, sf_dir).count() > 0
        return
    ours, theirs = both(spark, sf_dir, run, sql)
    assert ours == theirs
    assert ours, "a query without rows proves nothing"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
