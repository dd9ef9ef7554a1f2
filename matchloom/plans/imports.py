"""Ingestion state: due imports, live events, windows, retention, projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import normalized_status
from matchloom.functions.times import instant, same_local_day
from matchloom.operators.keyed import latest_per_key, merge_upsert, top_per_key
from matchloom.session import path_exists

# Spellings of running and finished states after separators are removed.
RUNNING = ["LIVE", "ACTIVE", "RUNNING", "STARTED", "INPROGRESS", "EVENTINPROGRESS"]
FINISHED = ["COMPLETE", "COMPLETED", "FINISHED", "ENDED", "CANCELLED", "CANCELED",
            "EVENTCOMPLETE", "EVENTCOMPLETED", "EVENTFINISHED", "EVENTENDED",
            "EVENTCANCELLED", "EVENTCANCELED"]
RETRYABLE = ["discovered", "pending", "partial", "no_results", "failed"]
STATUS_COLUMNS = ["display_status", "event_status", "lifecycle_status"]


def in_progress(columns: list[str] = STATUS_COLUMNS) -> Column:
    """Any status column says running and none says finished."""
    states = [normalized_status(F.col(c)) for c in columns]
    running, finished = F.lit(False), F.lit(False)
    for s in states:
        running, finished = running | s.isin(RUNNING), finished | s.isin(FINISHED)
    return running & ~finished


def due_for_refresh(events, sync_state, queued, now: dt.datetime, lookback: dt.timedelta,
                    retry_after: dt.timedelta, recent: dt.timedelta, limit: int) -> DataFrame:
    """Events due for import, least recently attempted first; ``queued`` holds text keys."""
    attempt, state = F.col("last_attempt_at"), F.col("state")
    final = F.col("end_datetime") + F.expr("interval 2 hours")
    final_due = F.col("end_datetime").isNotNull() & (final <= instant(now)) & (
        attempt.isNull() | (attempt < final))
    recently = F.coalesce("end_datetime", "start_datetime") >= instant(now - recent)
    wanted = state.isin(RETRYABLE) | (
        (state == "complete") & recently & (in_progress() | F.coalesce(final_due, F.lit(False))))
    rows = (
        events.filter((F.col("start_datetime") >= instant(now - lookback))
                      & (F.col("start_datetime") <= instant(now)))
        .join(sync_state, "event_id")
        .filter(wanted & (attempt.isNull() | (attempt <= instant(now - retry_after))))
        .withColumn("_key", F.col("event_id").cast("string"))
        .join(queued.select(F.col("resource_key").alias("_key")), "_key", "left_anti")
    )
    return rows.orderBy(attempt.asc_nulls_first(), "start_datetime", "event_id").limit(
        limit).select("event_id", "state", "last_attempt_at")


def team_events(events, registrations, links, roster_df) -> DataFrame:
    """Events with the roster members registered for them, matched by player id."""
    members = links.join(roster_df, "member_id").select(
        "slug", "member_id", "preferred_display_name", "player_id")
    return events.join(registrations.select("event_id", "player_id", "registration_status", "registration_synced"),
                       "event_id").join(members, "player_id")


def eligible_live_events(team_rows: DataFrame, now: dt.datetime, fresh_after: dt.datetime) -> DataFrame:
    """Running events with a member who takes part and a usable address; both read lately."""
    return team_rows.filter(
        F.upper(F.trim("registration_status")).isin("ACTIVE", "COMPLETE")
        & (F.col("last_synced") >= instant(fresh_after))
        & (F.col("registration_synced") >= instant(fresh_after))
        & (F.col("start_datetime") <= instant(now)) & (F.col("end_datetime") > instant(now))
        & (F.length(F.trim("source_url")) > 0) & in_progress()
    ).select("slug", "event_id", "name", "source_url", "timezone", "start_datetime",
             "preferred_display_name").distinct()


def budget_fill(first: DataFrame, rotation: DataFrame, key: str, rotation_order: list[Column],
                limit: int) -> DataFrame:
    """Up to ``limit`` keys: the first tier by key, then the rotation with what is left."""
    own = first.select(key).distinct().orderBy(key).limit(limit).withColumn("tier", F.lit(0))
    own = own.withColumn("pos", F.row_number().over(Window.orderBy(key)))
    rest = rotation.join(own.select(key), key, "left_anti").orderBy(*rotation_order).limit(limit)
    rest = rest.withColumn("pos", F.row_number().over(Window.orderBy(*rotation_order)))
    rest = rest.select(key, F.lit(1).alias("tier"), "pos")
    # Both sides hold at most ``limit`` rows here, so numbering them in one task is bounded.
    return own.select(key, "tier", "pos").unionByName(rest).orderBy("tier", "pos").limit(limit)


def current_day_only(rows: DataFrame, now: dt.datetime, valid_zones: list[str]) -> DataFrame:
    return rows.filter(same_local_day(
        F.col("start_datetime"), F.col("timezone"), instant(now), valid_zones))


def live_message(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Alert text per team and event: title, distinct player names without case, address.

    Names beyond what ``limit`` characters can hold never reach the text: only the first
    ``limit`` names of an event are gathered, in order, so the list is bounded.
    """
    named = rows.select("slug", "event_id", "name", "source_url", "preferred_display_name").distinct()
    head = top_per_key(named, ["slug", "event_id"],
                       [F.lower("preferred_display_name"), F.col("preferred_display_name")],
                       limit, "_n")
    joined = head.groupBy("slug", "event_id", "name", "source_url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "_n", "preferred_display_name"))), lambda x: x["preferred_display_name"]), ", ")
        .alias("players"))
    title, url = F.trim("name"), F.trim("source_url")
    whole = F.concat(F.lit("**"), title, F.lit("**\nPlaying: "), F.col("players"), F.lit("\n"), url)
    room = F.least(F.lit(300), F.greatest(F.lit(1), limit - (F.length(url) + 11) - 4))
    prefix = F.concat(F.lit("**"), F.substring(title, F.lit(1), room), F.lit("**\nPlaying: "))
    left = F.greatest(F.lit(1), limit - F.length(prefix) - F.length(url) - 2)
    cut = F.concat(prefix, F.substring(F.col("players"), F.lit(1), left), F.lit("\n"), url)
    return joined.select("slug", "event_id",
                         F.when(F.length(whole) <= limit, whole).otherwise(cut).alias("message"))


def select_window_dedup(rows: DataFrame, start, end, key: str, at: str, order: str) -> DataFrame:
    """Give every discovered row its fate: missing id, missing time, outside, copy, selected.

    Copies are looked for among rows inside the window only and the first one stays.
    """
    inside = F.col(key).isNotNull() & F.col(at).isNotNull() & (
        F.col(at) >= instant(start)) & (F.col(at) < instant(end))
    first = rows.filter(inside).groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key, "left").withColumn(
        "fate", F.when(F.col(key).isNull(), "missing_id").when(F.col(at).isNull(), "missing_datetime")
        .when(~inside, "boundary_excluded").when(F.col(order) > F.col("_first"), "duplicate")
        .otherwise("selected")).drop("_first")


def retention_slice(rows: DataFrame, at: str, key: str, cutoff, limit: int,
                    terminal: Column) -> DataFrame:
    """The oldest finished rows before the cutoff, at most ``limit`` of them."""
    return rows.filter(terminal & (F.col(at) < instant(cutoff))).orderBy(at, key).limit(limit)


def pending_projection(sources: DataFrame, models: DataFrame, key: str, version: int) -> DataFrame:
    """Sources whose read model is missing or of another version."""
    ready = models.filter(F.col("version") == version).select(key)
    return sources.join(ready, key, "left_anti")


class ReadModel:
    """A derived table, one row per source key, made of another version of its sources.

    Each refresh appends the rows it made under its own number; the newest row of a key counts. A refresh takes the
    sources that lack a row of the wanted version, in key order, at most ``limit`` of them. It can be stopped and
    started again: what was written is not made twice, and a new version makes all rows anew.
    """

    def __init__(self, spark, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _all(self) -> DataFrame:
        schema = f"{self.schema}, version int, refresh int"
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(f"{self.root}/refresh=*")

    def read(self) -> DataFrame:
        """The newest row of each key, with its version."""
        return latest_per_key(self._all(), [self.key], [F.col("refresh").desc()]).drop("refresh")

    def refresh(self, sources: DataFrame, project: Callable[[DataFrame], DataFrame], version: int, limit: int) -> int:
        """Make and store the next rows; returns how many."""
        rows = self._all()
        due = pending_projection(sources, rows.select(self.key, "version").distinct(), self.key, version)
        number = (rows.agg(F.max("refresh")).first()[0] or 0) + 1
        made = project(due.orderBy(self.key).limit(limit)).withColumn("version", F.lit(version))
        path = f"{self.root}/refresh={number}"
        made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()


def sync_state(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sync state per event after some attempts: state and error are the newest, a success outlives later failures.

    ``attempts``: event_id, attempt_at, state, error, success_at, revision; a failed attempt has no success or revision.
    """
    newest = attempts.groupBy("event_id").agg(
        *[F.max_by(c, F.struct("attempt_at", "state")).alias(c) for c in ("state", "error")],
        F.max("attempt_at").alias("attempt_at"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("attempt_at"))).alias(c) for c in ("success_at", "revision")])
    return merge_upsert(current, newest, ["event_id"], {
        "state": "overwrite", "error": "overwrite", "attempt_at": "prefer_new", "success_at": "prefer_new",
        "revision": "prefer_new"}, [F.col("attempt_at").desc()])


def finish_attempts(log: DataFrame) -> DataFrame:
    """One row per import attempt from its append-only start and finish rows; unfinished attempts are ``running``."""
    ended = F.when(F.col("kind") == "finish", F.struct("at", "status", "rows", "error"))
    return log.groupBy("attempt_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"), F.max(ended).alias("_end")).select(
        "attempt_id", "started_at", F.col("_end.at").alias("finished_at"),
        F.coalesce("_end.status", F.lit("running")).alias("status"), F.col("_end.rows").alias("rows"),
        F.substring("_end.error", 1, 1000).alias("error"))


def pending_by_key(requests: DataFrame, runs: DataFrame, payload: list[str]) -> DataFrame:
    """Decide per request: cached result, restart of a failed run, or a new run.

    The key is a hash of every input, so equal requests share one run.
    """
    keyed = requests.withColumn("run_key", F.sha2(F.to_json(F.struct(*sorted(payload))), 256))
    once = keyed.dropDuplicates(["run_key"])
    state = runs.groupBy("run_key").agg(
        F.bool_or(F.col("status") == "succeeded").alias("_done"))
    return once.join(state, "run_key", "left").withColumn(
        "decision", F.when(F.col("_done"), "cached").when(F.col("_done").isNotNull(), "restart")
        .otherwise("new")).drop("_done")


def stale_versions(rows: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Rows produced by another parser, extractor or projection version."""
    stale = F.lit(False)
    for column, version in expected.items():
        stale = stale | ~F.col(column).eqNullSafe(F.lit(version))
    return rows.filter(stale)


def pending_windows(days: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """Day windows to ingest: all of them when forced, else those without a completed run."""
    if force:
        return days
    done = log.filter(F.col("status") == "completed").select("day")
    return days.join(done, "day", "left_anti")


def check_window(start: dt.date, end: dt.date) -> None:
    if not 0 < (end - start).days <= 366:
        raise ValueError("a window covers 1 to 366 days")


def account_sync_state(log: DataFrame) -> DataFrame:
    """Current state per account from its sync log of begin, checkpoint, finish and error rows.

    The latest row of each kind decides its columns: a finish or begin clears the error, an
    error keeps the last success, the cursor moves only with checkpoints and finishes.
    """
    kind, at = F.col("kind"), F.struct("at", "log_id")

    def newest(value, *kinds):
        return F.max_by(value, F.when(kind.isin(*kinds), at))
    failed = kind == "error"
    return log.groupBy("account_id").agg(
        newest(F.when(failed & F.col("auth_error"), "auth_error").otherwise("active"), "finish", "error")
        .alias("status"),
        newest(F.col("cursor"), "checkpoint", "finish").alias("sync_cursor"),
        newest(F.col("history_exhausted"), "checkpoint", "finish").alias("history_exhausted"),
        F.max(F.when(kind == "begin", F.col("at"))).alias("last_sync_started_at"),
        F.max(F.when(kind == "finish", F.col("at"))).alias("last_sync_completed_at"),
        newest(F.when(failed, F.substring("error_category", 1, 100)), "begin", "finish", "error")
        .alias("last_error_category"),
        newest(F.when(failed, F.substring("error_text", 1, 1000)), "begin", "finish", "error")
        .alias("last_error_summary"))


def ingest_totals(log: DataFrame) -> DataFrame:
    """Totals over the ingest log, by outcome."""
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("received").alias("received"),
        F.sum("selected").alias("selected"))


def ingest_window(rows: DataFrame, target: DataFrame, log: DataFrame, start: dt.date, end: dt.date,
                  key: str, at: str, order: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ingest the day windows of [start, end) that have no completed run.

    Returns the target with the selected rows added where absent, and one log row per day
    with its counters. Days are half-open in UTC.
    """
    check_window(start, end)
    days = rows.sparkSession.range((end - start).days).select(
        F.date_add(F.lit(start.isoformat()).cast("date"), F.col("id").cast("int")).alias("day"))
    todo = pending_windows(days, log, force)
    fates = select_window_dedup(rows, start.isoformat(), end.isoformat(), key, at, order).withColumn(
        "day", F.to_date(at))
    due = fates.join(todo, "day", "left_semi")
    picked = due.filter(F.col("fate") == "selected").select(*target.columns)
    merged = target.unionByName(picked.join(target.select(key), key, "left_anti"))
    counts = due.groupBy("day").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("fate") == "selected").alias("selected"))
    done = todo.join(counts, "day", "left").select(
        "day", F.lit("completed").alias("status"), F.coalesce("received", F.lit(0)).alias("received"),
        F.coalesce("selected", F.lit(0)).alias("selected"))
    return merged, done


def latest_error(log: DataFrame, keys: list[str], order: str, error: str) -> DataFrame:
    """The error text of each key's newest log row (NULL when that row has none)."""
    return log.groupBy(*keys).agg(
        F.max(order).alias("last_id"), F.max_by(error, order).alias("last_error"))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not stored yet, one per key: decklists, findings, reports."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.select(*rows.columns).write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only facts: usage, observations, import attempts."""
    rows.write.mode("append").parquet(path)
