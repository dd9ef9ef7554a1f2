"""Streaming jobs run over the given tables and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.ratings import published, r6
from matchloom.plans import bindings as b
from matchloom.session import scratch_path
from matchloom.streaming import jobs as s


def read_stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def parts(df, column, size, first, n=3):
    """The table in ``n`` consecutive parts, as new data would arrive."""
    slot = F.floor((F.col(column) - first) * n / size)
    return [df.filter(slot == i) for i in range(n)]


def source(spark, sf, name):
    """Stream over the table's file, matched by name inside its folder."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def usage_rows(raw):
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        F.col("ts").alias("occurred_at"), F.col("event_type").alias("command_name"), "user_id",
        (F.col("value") >= 5).alias("succeeded"), (F.col("value") * 10).cast("int").alias("duration_ms"),
        k.alias("k"))


@query("usage_stream", "select date_trunc('day', occurred_at) as window_start, command_name, count(*) as uses, count(*) filter (not succeeded) as failures, sum(duration_ms)::bigint as total_ms from v_usage group by 1, 2")
def usage_stream(spark, sf):
    out = scratch_path(spark, "usage-stream")
    counts = s.usage_stream(usage_rows(source(spark, sf, "events")))
    q = (counts.writeStream.outputMode("complete").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@query("alert_once", "select distinct event_id // 50 as event_id, user_id % 5 as channel_id from events where ts is not null")
def alert_once(spark, sf):
    raw = source(spark, sf, "events").select(
        F.expr("event_id div 50").alias("event_id"), (F.col("user_id") % 5).alias("channel_id"),
        F.col("ts").alias("seen_at"))
    table = s.reservations(spark, scratch_path(spark, "alerts"), 8)
    s.once(raw, scratch_path(spark, "cp"), s.alert_once(table, "1000 days")).awaitTermination()
    return table.read().select("event_id", "channel_id")


@query("alert_batches", """with p as (select user_id as e, event_id % 5 as c, ts, event_id * 4 // (select max(event_id) + 1 from events) as n from events),
 f as (select * from p where ts is not null qualify ts >= max(ts) over (partition by n) - interval 7 day),
 g as (select e, c, n, min(ts) as ts from f group by all)
 select e as event_id, c as channel_id, ts as seen_at, n::bigint as batch from g qualify row_number() over (partition by e, c order by n) = 1""")
def alert_batches(spark, sf):
    """All events as four batches, one of them run twice: stale alerts and reserved pairs are left out."""
    raw = b.table(spark, sf, "events").select(
        F.col("user_id").alias("event_id"), (F.col("event_id") % 5).alias("channel_id"), F.col("ts").alias("seen_at"),
        F.col("event_id").alias("n"))
    top = raw.agg(F.max("n")).first()[0]
    table = s.reservations(spark, scratch_path(spark, "alerts"), 8)
    handle, batches = s.alert_once(table, "7 days"), parts(raw, "n", top + 1, 0, 4)
    for i in (0, 1, 2, 2, 3):
        handle(batches[i], i)
    return table.read()


@query("incremental_upsert", "select account_id, game_id, min(ts) as first_seen, max(ts) as last_seen, arg_max(event_type, (ts, event_id)) as result from (select user_id as account_id, event_id // 40 as game_id, * from events) group by 1, 2")
def incremental_upsert(spark, sf):
    """Observation upsert: the first sighting stays, everything else is overwritten."""
    raw = b.table(spark, sf, "events").select(
        F.col("user_id").alias("account_id"), F.expr("event_id div 40").alias("game_id"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
        F.col("event_type").alias("result"), "event_id")
    feed = scratch_path(spark, "feed")
    # One micro-batch holds several sightings of a key: the earliest fills first_seen, the
    # latest the rest. The parts arrive, and are merged, in time order.
    root = scratch_path(spark, "observations")
    schema = "account_id long, game_id long, first_seen timestamp_ntz, last_seen timestamp_ntz, result string"
    target = s.KeyedTable(spark, root, schema, ["account_id", "game_id"], 16)
    checkpoint, top = scratch_path(spark, "cp"), raw.agg(F.max("event_id")).first()[0]

    def handle(batch, number):
        seen = batch.groupBy("account_id", "game_id").agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            F.max_by("result", F.struct("last_seen", "event_id")).alias("result"))
        target.upsert(seen, number, {
            "first_seen": "keep_first", "last_seen": "overwrite", "result": "overwrite"},
            [F.col("last_seen").desc()])
    for part in parts(raw, "event_id", top + 1, 0):
        part.write.mode("append").parquet(feed)
        s.once(read_stream(spark, feed, raw.schema), checkpoint, handle).awaitTermination()
    return target.read()


@query("incremental_elo", "select sequence, player_id, round(rating_after, 6) as rating_after from v_history")
def incremental_elo(spark, sf):
    """The published inputs fed in three batches give the same history as one build."""
    inputs = published(spark, sf).inputs
    feed, root = scratch_path(spark, "inputs"), scratch_path(spark, "elo-stream")
    checkpoint = scratch_path(spark, "cp")
    for part in parts(inputs, "sequence", inputs.count(), 1):
        part.write.mode("append").parquet(feed)
        stream = read_stream(spark, feed, inputs.schema)
        s.incremental_elo(spark, stream, root, checkpoint).awaitTermination()
    return spark.read.parquet(f"{root}/history").select("sequence", "player_id", r6("rating_after"))


@query("incremental_append", "select game_id, account_id, event_id from (select *, row_number() over (partition by account_id, game_id order by event_id desc) n from v_obs where (account_id, game_id) not in (select account_id, game_id from v_obs where event_id % 10 < 4)) where n = 1")
def incremental_append(spark, sf):
    o = b.observations(spark, sf)
    known = o.filter(F.col("event_id") % 10 < 4)
    return s.incremental_append(o, known, ["account_id", "game_id"], [F.col("event_id").desc()]).select(
        "game_id", "account_id", "event_id")
