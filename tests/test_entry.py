import __spark_entry__ as entry

from tidegraph import queries


def test_queries_and_sql_match():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    found = entry.queries()
    assert set(queries.queries()) <= set(found) and set(entry.oracle_sql()) <= set(found)
    assert all(callable(q) for q in found.values())
