from pyspark.sql import functions as F

from lodestack.io import load
from lodestack.operators import windows as W
from lodestack.streaming import state


def events(spark, folder, tmp_path, parts=3):
    df = load(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value").filter("user_id is not null")
    df.repartitionByRange(parts, "ts").write.parquet(str(tmp_path / "in"))
    return df, state.read_events(spark, str(tmp_path / "in"), df.schema, 99)


def run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sticky_equals_batch(spark, folder, tmp_path):
    batch, stream = events(spark, folder, tmp_path)
    got = {(r.id, r.session) for r in run(state.sticky(stream, "user_id", "ts", "event_id", 21_600), spark, "sticky").collect()}
    want = {(r.event_id, r.session) for r in W.sessions(batch, ["user_id"], F.unix_micros("ts"), 21_600, "event_id").collect()}
    assert got == want


def test_once_and_windows(spark, folder, tmp_path):
    batch, stream = events(spark, folder, tmp_path)
    once = run(state.once(stream, "ts", ["user_id", "event_type"], "400 days"), spark, "once")
    assert once.count() == batch.select("user_id", "event_type").distinct().count()
    rolled = run(state.rolling(stream, "ts", ["event_type"], "1 day", "1 day", "1 hour"), spark, "rolled")
    per = batch.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert rolled.join(per, ["window", "event_type"]).filter("events <> n").count() == 0 and rolled.count() > 0
    assert run(state.sessions(stream, "ts", ["user_id"], "6 hours", "1 hour"), spark, "sessions").agg(F.sum("events")).collect()[0][0] > 0


def test_incremental_skips_what_is_stored(spark, folder, tmp_path):
    batch, stream = events(spark, folder, tmp_path)
    store = str(tmp_path / "store")
    batch.limit(0).write.parquet(store)
    for turn in range(2):
        q = state.incremental(stream, lambda: spark.read.parquet(store), "event_id", lambda df: df, lambda df: df.write.mode("append").parquet(store), str(tmp_path / f"check{turn}"))
        q.awaitTermination(120)
    assert spark.read.parquet(store).count() == batch.select("event_id").distinct().count()
