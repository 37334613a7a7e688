"""The driver contract."""

import __spark_entry__ as E


def test_entry_ranks_pages(spark):
    got = E.entry(spark)
    assert got.columns == ["query_id", "page", "score", "rank"]
    rows = got.collect()
    assert sorted((r.query_id, r.rank) for r in rows) == [(q, k) for q in range(5) for k in range(1, 11)]


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
