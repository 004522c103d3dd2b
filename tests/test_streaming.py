"""Streams driven to their end over files."""

from pyspark.sql import functions as F

from loomcube.streaming import events


def drive(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def source(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    for i, part in enumerate(df.randomSplit([1.0], 1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")


def test_counts_by_window(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 3.0), (4, "2024-01-02 00:00:00", "b", 4.0)]
    out = drive(spark, events.windowed_counts(source(spark, tmp_path, rows)), "counts")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in out.collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_repeats_are_dropped(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:11:00", "a", 1.0), (2, "2024-01-01 00:12:00", "a", 1.0)]
    assert drive(spark, events.deduplicated(source(spark, tmp_path, rows), "event_id", "ts"), "repeats").count() == 2


def test_upsert(frame):
    known, batch = frame([(1, 1, "old"), (2, 5, "kept")], "k long, v int, x string"), frame([(1, 2, "new"), (2, 4, "late"), (3, 1, "first")], "k long, v int, x string")
    assert sorted(tuple(r) for r in events.upsert(batch, known, "k", "v").collect()) == [(1, 2, "new"), (2, 5, "kept"), (3, 1, "first")]
