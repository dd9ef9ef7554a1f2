import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchloom.streaming import jobs as s

SIGHT = "account long, game long, first_seen int, last_seen int, result string"


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_upsert_is_idempotent_and_keeps_the_first_sighting(spark, tmp_path):
    feed = tmp_path / "feed"
    batches = [[(1, 1, 5, 5, "a")], [(1, 1, 9, 9, "b"), (2, 1, 9, 9, "c")], [(1, 1, 9, 9, "b")]]
    for rows in batches:
        spark.createDataFrame(rows, SIGHT).coalesce(1).write.mode("append").parquet(str(feed))
    target = s.KeyedTable(spark, str(tmp_path / "t"), SIGHT, ["account", "game"], 8)
    rules = {"first_seen": "keep_first", "last_seen": "overwrite", "result": "overwrite"}
    run = lambda: s.incremental_upsert(stream(spark, feed, SIGHT), target, str(tmp_path / "cp"),
                                       rules, [F.col("last_seen").desc()]).awaitTermination()
    run()
    want = [(1, 1, 5, 9, "b"), (2, 1, 9, 9, "c")]
    assert sorted(map(tuple, target.read().collect())) == want
    run()  # nothing new
    assert sorted(map(tuple, target.read().collect())) == want
    target.upsert(spark.createDataFrame(batches[1], SIGHT), 1, rules, [F.col("last_seen").desc()])
    assert sorted(map(tuple, target.read().collect())) == want  # a repeated batch gives the same version
    assert sorted(map(tuple, target.read(before=1).collect())) == [(1, 1, 5, 5, "a")]
    written = [p.name for p in (tmp_path / "t" / "data" / "version=2").iterdir() if p.is_dir()]
    assert len(written) == 1  # the last batch held one key and rewrote one bucket


def test_late_match_stops_the_stream(spark, tmp_path):
    schema = "sequence long, match_id long, event_id long, player1_id long, player2_id long, winner_id long, is_draw boolean"
    feed = tmp_path / "feed"
    for seq in (5, 3):
        spark.createDataFrame([(seq, seq, 1, 1, 2, 1, False)], schema).coalesce(1).write.mode("append").parquet(str(feed))
    q = s.incremental_elo(spark, stream(spark, feed, schema), str(tmp_path / "r"), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="late match"):
        q.awaitTermination()


def test_alert_is_sent_once_per_channel(spark, tmp_path):
    schema = "event_id long, channel_id long, seen_at timestamp_ntz"
    t = dt.datetime(2026, 1, 1)
    for rows in ([(1, 1, t), (1, 2, t), (1, 1, t)], [(1, 1, t + dt.timedelta(minutes=3)), (2, 1, t)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = s.reservations(spark, str(tmp_path / "out"), 4)
    s.once(stream(spark, tmp_path / "in", schema), str(tmp_path / "cp"), s.alert_once(out)).awaitTermination()
    assert sorted((x.event_id, x.channel_id) for x in out.read().collect()) == [(1, 1), (1, 2), (2, 1)]


def test_late_and_repeated_alerts(spark, tmp_path):
    schema = "event_id long, channel_id long, seen_at timestamp_ntz"
    t = dt.datetime(2026, 1, 1)
    out = s.reservations(spark, str(tmp_path / "out"), 4)
    handle = s.alert_once(out, "1 hour")
    batches = [[(1, 1, t)], [(1, 1, t + dt.timedelta(minutes=70)), (9, 9, t - dt.timedelta(days=1)), (8, 8, None)],
               [(7, 7, t + dt.timedelta(minutes=5)), (7, 7, t + dt.timedelta(minutes=2))], []]
    for n in (0, 1, 2, 2, 3):
        handle(spark.createDataFrame(batches[n], schema), n)
    got = out.read().select("event_id", "channel_id", "batch", "seen_at").collect()
    # reserved before: none again; a late first sighting: sent; stale or without a time: none
    assert sorted(map(tuple, got)) == [(1, 1, 0, t), (7, 7, 2, t + dt.timedelta(minutes=2))]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "data").rglob("*.parquet")}
    handle(spark.createDataFrame([(7, 7, t)], schema), 4)
    assert all(p.stat().st_mtime_ns == m for p, m in before.items())  # old versions stay as they are
    assert len(list((tmp_path / "out" / "data" / "version=4").glob("_bucket=*"))) == 1


def test_usage_windows(spark, tmp_path):
    schema = "occurred_at timestamp_ntz, command_name string, succeeded boolean, duration_ms int"
    rows = [(dt.datetime(2026, 1, 1, 1), "a", True, 5), (dt.datetime(2026, 1, 1, 23), "a", False, 7), (dt.datetime(2026, 1, 2), "a", True, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = s.usage_stream(stream(spark, tmp_path / "in", schema)).writeStream.outputMode("complete").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(out)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x.window_start, x.uses, x.failures, x.total_ms) for x in spark.read.parquet(out).collect())
    assert got == [(dt.datetime(2026, 1, 1), 2, 1, 12), (dt.datetime(2026, 1, 2), 1, 0, 1)]
