"""Structured Streaming versions of the usage, alert, ingest and rating jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.keyed import latest_per_key, merge_upsert
from matchloom.session import materialize, path_exists


def usage_stream(usage: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Commands per window and name with failures and total duration; late rows are dropped
    once the watermark has passed their window."""
    return (
        usage.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
        .groupBy(F.window("at", window), "command_name")
        .agg(F.count(F.lit(1)).alias("uses"), F.count_if(~F.col("succeeded")).alias("failures"),
             F.sum("duration_ms").alias("total_ms"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "command_name",
                "uses", "failures", "total_ms"))


RESERVED = "event_id long, channel_id long, seen_at timestamp_ntz, batch long"


def reservations(spark: SparkSession, root: str, buckets: int = 64) -> KeyedTable:
    """The table that ``alert_once`` keeps, in buckets by (event, channel)."""
    return KeyedTable(spark, root, RESERVED, ["event_id", "channel_id"], buckets)


def alert_once(reserved: KeyedTable, fresh_for: str = "10 minutes") -> Callable:
    """Batch handler that reserves every (event, channel) once, for ``once``.

    An alert counts if it was seen at most ``fresh_for`` before the newest of its batch, which is the batch's
    own time, and its pair is not reserved yet, however late it comes. A batch reads and rewrites only the
    buckets of its pairs. Run again, it starts from the state before it and reserves the same pairs; the alerts
    to send are the rows that carry its number. Alerts without a time are never fresh.
    """
    def reserve(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.select(*[c.split()[0] for c in RESERVED.split(", ")[:3]]), "alerts")
        now = rows.agg(F.max("seen_at")).first()[0]
        if now is None:
            return
        fresh = rows.filter(F.col("seen_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {fresh_for}"))
        reserved.upsert(fresh.withColumn("batch", F.lit(batch_id).cast("long")), batch_id,
                        {"seen_at": "keep_first", "batch": "keep_first"}, [F.col("seen_at")])

    return reserve


def once(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything available now in micro-batches, then stop."""
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class KeyedTable:
    """A keyed table in hash buckets whose batches rewrite only the buckets they touch.

    Batch ``n`` writes the new content of its buckets under ``data/version=n`` and then lists
    them under ``manifest/version=n``; the newest listed version of a bucket counts. A batch
    repeated after a failure starts from the versions before it and overwrites its own, so
    nothing is applied twice and nothing is read while it is written.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.buckets = keys, self._layout(buckets)

    def _layout(self, wanted: int) -> int:
        """The number of buckets the table was made with; ``wanted`` counts for a new table only."""
        path = f"{self.root}/layout"
        if not path_exists(self.spark, path):
            self.spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.parquet(path)
        return self.spark.read.schema("buckets int").parquet(path).first()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows as of the versions before ``before``, optionally of some buckets only."""
        listed = f"{self.root}/manifest"
        if not path_exists(self.spark, listed):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema("bucket int, version int").parquet(listed)
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        if only is not None:
            rows = rows.filter(F.col("bucket").isin(only))
        newest = rows.groupBy("bucket").agg(F.max("version").alias("v")).collect()  # one row per bucket
        paths = [f"{self.root}/data/version={r['v']}/_bucket={r['bucket']}" for r in newest]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most ``buckets``

    def upsert(self, batch: DataFrame, version: int, rules: dict[str, str], order) -> None:
        staged = materialize(batch, "batch")
        only = self.touched(staged)
        merged = merge_upsert(self.read(version, only), staged, self.keys, rules, order)
        merged.withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy(
            "_bucket").parquet(f"{self.root}/data/version={version}")
        self.spark.createDataFrame([(b,) for b in only], "bucket int").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.root}/manifest/version={version}")


def incremental_upsert(stream: DataFrame, target: KeyedTable, checkpoint: str,
                       rules: dict[str, str], order) -> StreamingQuery:
    """Merge every micro-batch into the table; seeing a row again changes nothing."""
    return once(stream, checkpoint, lambda batch, i: target.upsert(batch, i, rules, order))


def incremental_append(new: DataFrame, known: DataFrame, keys: list[str], order) -> DataFrame:
    """Rows whose key is not stored yet, one per key; keep reading pages while any come back."""
    return latest_per_key(new.join(known.select(*keys), keys, "left_anti"), keys, order)


def incremental_elo(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Extend a rating history batch by batch.

    Batches carry inputs in sequence order. A batch starts from the last rating of its players
    in the versions before it. An input at or before the stored last sequence means
    history changed: the batch fails and a full rebuild is due.
    """
    from matchloom.plans.elo import HISTORY_SCHEMA, elo_history
    state = KeyedTable(spark, f"{root}/state", "player_id long, rating double, sequence long", ["player_id"])
    progress = f"{root}/progress"

    def step(batch: DataFrame, number: int) -> None:
        inputs = materialize(batch, "elo-batch")
        span = inputs.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
        if span["lo"] is None:
            return
        if path_exists(spark, progress):
            past = spark.read.schema("hi long, version int").parquet(progress).filter(
                F.col("version") < number).agg(F.max("hi")).first()[0]
            if past is not None and span["lo"] <= past:
                raise ValueError("late match: rebuild the run")
        players = inputs.select(F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
        known = state.read(number, state.touched(players)).select("player_id", "rating")
        history = elo_history(inputs, initial=known)
        history.write.mode("overwrite").parquet(f"{root}/history/batch={number}")
        done = spark.read.schema(HISTORY_SCHEMA).parquet(f"{root}/history/batch={number}")
        newest = done.groupBy("player_id").agg(
            F.max_by("rating_after", "sequence").alias("rating"), F.max("sequence").alias("sequence"))
        state.upsert(newest, number, {"rating": "overwrite", "sequence": "overwrite"},
                     [F.col("sequence").desc()])
        spark.createDataFrame([(span["hi"],)], "hi long").coalesce(1).write.mode("overwrite").parquet(
            f"{progress}/version={number}")

    return once(stream, checkpoint, step)
