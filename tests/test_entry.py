import __spark_entry__ as entry


def test_flagship_query_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
