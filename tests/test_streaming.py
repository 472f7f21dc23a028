"""The streaming operators as streams: what a stream over all files gives is what the batch gives."""

from pyspark.sql import functions as F

from quern.streaming import events as S


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def source(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    return S.timed(e), S.stream(spark, f"{tmp_path}/in", e.schema, files=10)


def test_tumbling(spark, sf, tmp_path):
    batch, live = source(spark, sf, tmp_path)
    assert rows(S.run_available(S.tumbling(live), "tumbling", "complete")) == rows(S.tumbling(batch))


def test_append_gives_closed_windows(spark, sf, tmp_path):
    batch, live = source(spark, sf, tmp_path)
    got, want = set(rows(S.run_available(S.tumbling(live), "closed", "append", f"{tmp_path}/cp"))), set(rows(S.tumbling(batch)))
    assert got and got <= want


def test_once(spark, sf, tmp_path):
    batch, live = source(spark, sf, tmp_path)
    got = S.run_available(S.once(live, ["event_id"]).select("event_id"), "once")
    assert got.count() == batch.select("event_id").distinct().count()


def test_running_totals(spark, sf, tmp_path):
    batch, live = source(spark, sf, tmp_path)
    out = S.run_available(S.running_totals(live), "totals", "update")
    last = out.groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
    assert rows(last) == rows(batch.groupBy("user_id", "event_type").agg(F.count("*").alias("n")))
