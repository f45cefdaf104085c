from traces import SCHEMA, S, two

from tracewarp.streaming.open_calls import match_stream


def test_stream_matches_calls(spark, tmp_path):
    rows = two(spark)
    for k, part in enumerate(("event_id < 9", "event_id >= 9")):
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = match_stream(stream).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["enter_event"]: (r["leave_event"], r["time_inc"] // S) for r in spark.table("calls").collect()}
    assert got[0] == (18, 100) and got[4] == (8, 8) and len(got) == 10
