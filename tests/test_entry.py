import __spark_entry__ as entry


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "page_no", "room_id"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
