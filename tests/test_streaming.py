from pyspark.sql import functions as F

from thalweg.streaming import events


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_windows_and_sessions(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    run(events.windowed(events.read(spark, str(tmp_path / "e")), "1 day"), "win", "complete")
    want = {(r.start, r.user_id): r.n for r in events.windowed(rows, "1 day").collect()}
    assert {(r.start, r.user_id): r.n for r in spark.table("win").collect()} == want
    run(events.sessions(events.read(spark, str(tmp_path / "e"))), "ses", "complete")
    assert spark.table("ses").agg(F.sum("n")).first()[0] == rows.count()
