import __spark_entry__ as entry


def test_entry_and_names(spark):
    got = entry.entry(spark)
    assert got.columns == ["year", "priority", "nation", "doc_count", "membership", "group_count"] and got.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
