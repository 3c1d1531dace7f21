import __spark_entry__ as E


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_streaming_prep_is_stateless(spark, tmp_path):
    from tabwright.operators import prep
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    sc = prep.fit_scaler(ev.select("value"), "zscore")
    stream = (spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet")
              .parquet("/root/testdata/sf0.001"))
    q = (sc.transform(stream.select("event_id", "value")).writeStream.format("memory").queryName("tw_scaled")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT avg(value) AS m FROM tw_scaled").first()["m"]
    assert abs(got) < 1e-9
