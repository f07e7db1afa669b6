import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["i", "doc_id", "start", "stop", "context_chars", "summary", "evidence"]
