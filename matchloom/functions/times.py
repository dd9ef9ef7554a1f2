"""Time coercion and calendar boundaries. Timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_ZONE = "America/New_York"
EPOCH_MILLIS = 1e11


def parse_timestamp(c) -> Column:
    """ISO text with a zone, or epoch seconds / milliseconds; anything else is NULL."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    seconds = F.when(F.abs(number) > EPOCH_MILLIS, number / 1000).otherwise(number)
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds)).when(
        zoned, F.try_to_timestamp(text))


def instant(value) -> Column:
    """Literal UTC wall-clock time, comparable with ``timestamp_ntz`` columns."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def _to_zone(c: Column, zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, c)


def _from_zone(c: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def weekly_boundary(now: Column) -> Column:
    """Latest Sunday 09:00 New York time at or before ``now`` (``timestamp_ntz`` in UTC)."""
    local = _to_zone(now, WEEK_ZONE)
    day = F.to_date(local)
    sunday = F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz")
    nine = sunday + F.expr("interval 9 hours")
    nine = F.when(nine > local, nine - F.expr("interval 7 days")).otherwise(nine)
    return _from_zone(nine, WEEK_ZONE)


def next_weekly_boundary(boundary: Column) -> Column:
    """The boundary seven local days later (167, 168 or 169 hours)."""
    return _from_zone(_to_zone(boundary, WEEK_ZONE) + F.expr("interval 7 days"), WEEK_ZONE)


def lookback_start(now: Column, days: int) -> Column:
    """Midnight UTC of the first of ``days`` calendar days ending today."""
    return F.date_sub(F.to_date(now), days - 1).cast("timestamp_ntz")


def same_local_day(start: Column, zone: Column, now: Column, valid_zones: list[str]) -> Column:
    """Both instants fall on one calendar day in the row's own zone; unknown zone is false."""
    known = F.coalesce(zone.isin(valid_zones), F.lit(False))
    safe = F.when(known, zone).otherwise("UTC")
    same = F.to_date(_to_zone(start, safe)) == F.to_date(_to_zone(now, safe))
    return known & F.coalesce(same, F.lit(False))
