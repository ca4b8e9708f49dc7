from meridia.streaming import log


def test_log_is_appended_once_and_counted_in_windows(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "click" if i % 2 else "view", float(i)) for i in range(20)], "event_id long, t string, event_type string, value double")
    rows = rows.selectExpr("event_id", "CAST(t AS TIMESTAMP) AS ts", "event_type", "value")
    rows.unionAll(rows.limit(3)).coalesce(1).write.parquet(source)
    stream = log.file_stream(spark, source, rows.schema)
    for _ in range(2):  # the second run finds nothing new
        log.append_once(stream, target, f"{tmp_path}/check", "event_id").awaitTermination()
    assert spark.read.parquet(target).count() == 20
    q = log.windowed_counts(stream, "ts", "event_type", "10 minutes", "5 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("w").collect() if r.start.minute == 10) == [("click", 5), ("view", 5)]
