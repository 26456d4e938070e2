"""Event-time windows on a stream of files and on a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.streaming import deduplicate, sessions, tumbling


def _events(spark):
    rows = [(1, "2024-01-01 00:00:10", "a"), (2, "2024-01-01 00:04:00", "a"), (3, "2024-01-01 00:06:00", "b"), (3, "2024-01-01 00:06:00", "b"), (4, "2024-01-01 01:00:00", "a")]
    return spark.createDataFrame(rows, "id int, ts string, k string").withColumn("ts", F.to_timestamp("ts"))


def test_batch(spark):
    df = _events(spark)
    assert {(str(r.window_start)[11:16], r.k, r.n) for r in tumbling(df, "ts", "5 minutes", ["k"], [F.count("*").alias("n")]).collect()} == {("00:00", "a", 2), ("00:05", "b", 2), ("01:00", "a", 1)}
    assert sorted(r.n for r in sessions(df, "ts", "10 minutes", ["k"], [F.count("*").alias("n")]).collect()) == [1, 2, 2]
    assert deduplicate(df, "ts", ["id"]).count() == 4


def test_stream(spark, tmp_path):
    df = _events(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = tumbling(stream, "ts", "5 minutes", ["k"], [F.count("*").alias("n")], late="1 minute")
    q = out.writeStream.outputMode("append").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n) for r in spark.table("tumbled").collect()} == {("a", 2), ("b", 2)}  # the last window is still open
