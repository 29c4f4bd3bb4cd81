import __spark_entry__ as entry


def test_every_query_has_a_name_and_sql_has_a_query():
    assert "mass_count" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["text_id", "pattern_id", "cnt"] and rows.count() > 0
