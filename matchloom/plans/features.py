"""Features of a game, from its action table: counts, own turns with their actions and how they began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRACTOR_VERSION = "features_v1"
ACTION_FIELDS = ("seq", "type", "gameplay_turn", "actor", "actor_is_perspective", "card_id", "card_name",
                 "card_instance_id", "source", "ability_name", "lore_gained")


def _cards(cards: Column) -> Column:
    return F.transform(cards, lambda c: F.struct(*[c[f].alias(f) for f in ("id", "name", "instance_id", "cost", "inkable")]))


def action_refs() -> Column:
    """The fields of an action that features keep, by sequence number."""
    return F.struct(*[F.col(f) for f in ACTION_FIELDS])


def own_turn_rows(actions: DataFrame) -> DataFrame:
    """One row per game and turn: how it began, the own actions in order, and all actions' types.

    Undone actions are left out. The start is that of the first own action. What has no turn, or belongs to the other
    player, is in the row without a turn; ``swap`` is the last mulligan of the row, undone or not. The lists are bounded
    by one archive, and combine before the shuffle.
    """
    live = F.coalesce(~F.col("undone"), F.lit(False))
    mine = live & F.coalesce(F.col("actor_is_perspective"), F.lit(False))
    turn = F.when(mine, F.col("gameplay_turn"))
    start = F.struct("seq", _cards(F.col("hand")).alias("hand"), "hand_count", "ink_count", "ready_ink", "lore")
    swap = F.struct("seq", F.size("mulligan_sent").alias("count"), _cards(F.col("mulligan_kept")).alias("kept"),
                    _cards(F.col("mulligan_sent")).alias("sent_back"), _cards(F.col("mulligan_drawn")).alias("drawn"))
    rows = actions.select(
        "game_id", turn.alias("turn"), F.when(turn.isNotNull(), start).alias("_start"), F.when(mine, action_refs()).alias("_ref"),
        F.when(live, F.struct(F.coalesce("type", F.lit("unknown")).alias("type"), mine.alias("own"))).alias("_kind"),
        F.when(F.col("mulligan_hand").isNotNull(), swap).alias("_swap"))
    return rows.groupBy("game_id", "turn").agg(
        F.min_by("_start", "_start.seq").alias("start"), F.sort_array(F.collect_list("_ref")).alias("actions"),
        F.collect_list("_kind").alias("kinds"), F.max_by("_swap", "_swap.seq").alias("swap"))


def _counts(kinds: Column) -> Column:
    """A map from each type to how often it occurs."""
    types = F.array_sort(F.array_distinct(kinds))
    return F.map_from_arrays(types, F.transform(types, lambda t: F.size(F.filter(kinds, lambda k: k == t)).cast("long")))


def extract_features(actions: DataFrame, games: DataFrame) -> DataFrame:
    """One row per game from ``normalize_actions`` and ``normalize_games``.

    Counts are maps from type to number; lists hold the actions of one archive. The actions are read once, and combine
    by game and turn before they are shuffled.
    """
    made = own_turn_rows(actions).groupBy("game_id").agg(
        F.flatten(F.collect_list("kinds")).alias("_kinds"), F.sort_array(F.flatten(F.collect_list("actions"))).alias("_actions"),
        F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "start", "actions")))).alias("_turns"),
        F.max_by("swap", "swap.seq").alias("mulligan"))
    some = F.size("_kinds") > 0
    made = made.select(
        F.col("game_id").alias("_game"), F.when(some, _counts(F.col("_kinds.type"))).alias("action_counts"),
        F.when(some, _counts(F.filter("_kinds", lambda k: k["own"])["type"])).alias("own_action_counts"),
        F.when(some, F.col("_actions")).alias("own_actions"), F.when(F.size("_turns") > 0, F.col("_turns")).alias("own_turns"),
        "mulligan")
    said = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a == b)
    seat = F.col("perspective")
    facts = games.select(
        "game_id", "perspective", "first_player", said(seat, F.col("first_player")).alias("went_first"), "winner",
        said(seat, F.col("winner")).alias("won"), "victory_reason", "turn_count", "undo_ranges",
        F.size("warnings").alias("warning_count"))
    return facts.join(made, F.col("game_id").eqNullSafe(F.col("_game")), "left").drop("_game").withColumn(
        "extractor_version", F.lit(EXTRACTOR_VERSION))
