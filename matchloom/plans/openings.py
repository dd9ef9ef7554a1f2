"""Practice openings over many replays: mulligans, hands, ink by own turn and card targets.

Every figure is a count or mean that combines before the shuffle, so a member with a third of all
replays is a few rows per task. Missing values leave a figure's denominator; only own turns
with a recorded end count as completed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.keyed import top_per_key


def _share(flag: Column, name: str) -> list[Column]:
    """How often ``flag`` holds, and of how many it is known."""
    return [F.count_if(flag).alias(name), F.count(flag).alias(f"{name}_known")]


def inspected_openings(replays: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """``replays`` with ``usable``: whether ``turn_rows`` (own turns) hold a complete timeline."""
    timeline = turn_rows.select("game_id").distinct().withColumn("_timeline", F.lit(True))
    return replays.join(timeline, "game_id", "left").select(
        *replays.columns, F.col("_timeline").isNotNull().alias("usable"))


def opening_hand_report(openings: DataFrame, hands: DataFrame, keys: list[str]) -> DataFrame:
    """Inspected and usable replays, cards returned, full sevens, hands with three uninkable cards."""
    rows = openings.join(hands.select("game_id", "mulligan_count", "post_uninkables"), "game_id", "left")
    returned = F.when(F.col("usable"), F.col("mulligan_count"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inspected"), F.count_if("usable").alias("usable"),
        F.count(returned).alias("mulligans_known"), F.avg(returned).alias("mulligan_mean"),
        F.count_if(returned == 7).alias("full_seven"),
        *_share(F.when(F.col("usable"), F.col("post_uninkables") >= 3), "three_uninkables"))


def opening_turn_report(openings: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Completed first three own turns: mean ink at the end and three or more, also by who went first."""
    rows = openings.filter("usable").join(
        turns.filter(F.col("complete")).select("game_id", "own_turn", "ink"), "game_id")
    three = F.col("ink") >= 3
    return rows.groupBy(*keys, "own_turn").agg(
        F.count(F.lit(1)).alias("completed"), F.avg("ink").alias("ink_mean"), *_share(three, "three_ink"),
        *_share(F.when(F.col("went_first"), three), "three_ink_first"),
        *_share(F.when(~F.col("went_first"), three), "three_ink_second"))


def _second_turns(turns: DataFrame) -> DataFrame:
    return turns.filter((F.col("own_turn") == 2) & F.col("complete")).select(
        "game_id", "end_seq", "target_seen", "target_played")


def opening_target_report(openings: DataFrame, hands: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Target held at first, kept and after the mulligan; seen and played on own turn 2; candidates."""
    held = hands.select("game_id", "initial_target", "kept_target", "post_target")
    rows = openings.filter("usable").join(held, "game_id", "left").join(_second_turns(turns), "game_id", "left")
    seen, played = F.col("target_seen"), F.col("target_played")
    return rows.groupBy(*keys).agg(
        *_share(F.col("initial_target"), "initial_target"),
        *_share(F.when(F.col("initial_target"), F.col("kept_target")), "kept_target"),
        *_share(F.col("post_target"), "post_target"), *_share(seen, "target_seen"),
        *_share(played, "target_played"), *_share(F.when(seen, played), "played_when_seen"),
        F.count_if(seen & ~played).alias("review_candidates"))


def review_candidates(openings: DataFrame, turns: DataFrame, keys: list[str],
                      limit: int | None = None) -> DataFrame:
    """Replays where a target was seen but not played on own turn 2; with ``limit`` the newest per key."""
    rows = openings.filter("usable").join(_second_turns(turns), "game_id").filter(
        F.col("target_seen") & ~F.col("target_played"))
    return rows if limit is None else top_per_key(rows, keys, [F.desc("started_at"), F.asc("game_id")], limit)
