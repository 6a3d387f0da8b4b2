from millrace.plans import registry


def test_strongest_scope_of_every_event(spark, tmp_path):
    spark.createDataFrame([(3, 1), (5, 1), (4, 2)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.scope: r.files for r in registry.QUERIES["strongest_scope"](spark, str(tmp_path)).collect()}
    assert got == {"file": 1, "extension": 1}  # event 5 is the only one that gives user 1 the scope "file"
