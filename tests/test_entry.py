def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert {"d_rule", "d_score", "stage_resolved"} <= set(df.columns)
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 55  # 58 registered, 56 with oracle SQL
