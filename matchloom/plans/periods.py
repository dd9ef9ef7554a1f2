"""Release periods and event search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.times import instant


def current_period(sets: DataFrame, now) -> DataFrame:
    """The latest named set with a positive numeric code released by ``now``; one row.

    Ties go to the higher code, then the later name. Unreadable dates are left out.
    """
    code = F.when(F.col("code").rlike(r"^\d+$"), F.col("code").cast("int"))
    start = F.try_to_timestamp("released_at").cast("timestamp_ntz")
    usable = sets.select("name", code.alias("code"), start.alias("start")).filter(
        (F.col("code") > 0) & (F.col("name") != "") & (F.col("start") <= instant(now)))
    best = usable.agg(F.max(F.struct("start", "code", "name")).alias("s"))
    return best.filter(F.col("s").isNotNull()).select("s.name", "s.code", "s.start")


def search_by_location(events: DataFrame, stores: DataFrame, column: str, places: list[str],
                       name_part: str) -> DataFrame:
    """Events at stores in any of the places whose name contains the text, ignoring case."""
    wanted = [p.strip().lower() for p in places]
    at = stores.filter(F.lower(F.trim(column)).isin(wanted))
    part = name_part.strip().lower()
    return events.filter(F.lower("name").contains(part)).join(at, "store_id").select(
        "event_id", "name", "store", column).orderBy("name", "event_id")
