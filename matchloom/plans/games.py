"""Roster, matchup, weekly, summary and practice reports over game observations."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.labels import (
    COLOUR_PAIRS, OUTCOME_NAMES, color_pair, colors_label, normalize_outcome, queue_label,
    wld_record)
from matchloom.functions.times import instant
from matchloom.operators.keyed import latest_per_key, mode_with_ties, top_per_key

QUEUE = ["queue_id", "queue_name", "mode", "match_format", "ranked"]
DECK_COLUMNS = ["your_deck_colors", "opponent_deck_colors"]


# --- roster ------------------------------------------------------------------------------

def roster(members, memberships, teams) -> DataFrame:
    """Active members with an open membership in an active team."""
    return (
        members.filter(F.col("status") == "active").drop("status")
        .join(memberships.filter(F.col("ended_at").isNull()), "member_id")
        .join(teams.filter(F.col("status") == "active").select("team_id", "slug", "team_name"),
              "team_id")
        .select("slug", "team_name", "member_id", "preferred_display_name", "role")
    )


def usable_account() -> Column:
    """Account in use whose credential names a non-blank environment entry."""
    ref = F.trim("credential_ref")
    return F.col("status").isin("active", "auth_error") & ref.startswith("env:") & (
        F.length(F.trim(F.expr("substring(trim(credential_ref), 5)"))) > 0)


def configured(roster_df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Roster rows with at least one usable account; several accounts do not repeat a row."""
    return roster_df.join(accounts.filter(usable_account()), "member_id", "left_semi")


def scope_to_owner(rows: DataFrame, owners: DataFrame, key: str = "member_id") -> DataFrame:
    """Keep rows whose owner is listed; ids supplied by a caller are never trusted."""
    return rows.join(owners.select(key), key, "left_semi")


def coverage(roster_df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Last sync per roster member, NULL kept; accounts and those needing attention."""
    per = accounts.groupBy("member_id").agg(
        F.max("last_sync_completed_at").alias("last_sync"), F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("status") != "active").alias("needs_attention"))
    return roster_df.join(per, "member_id", "left").select(
        "slug", "member_id", "preferred_display_name", "last_sync",
        F.coalesce("accounts", F.lit(0)).alias("accounts"),
        F.coalesce("needs_attention", F.lit(0)).alias("needs_attention"),
        F.col("last_sync").isNotNull().alias("synced"))


# --- observations ------------------------------------------------------------------------

def latest_observations(observations: DataFrame) -> DataFrame:
    """One observation per member and game: newest sighting, then lowest account."""
    return latest_per_key(observations, ["member_id", "game_id"],
                          [F.col("last_seen_at").desc(), F.col("account_id"), F.col("event_id")])


def game_results(observations, games, roster_df, since=None, until=None) -> DataFrame:
    """Latest observation per roster member and game, with the game's observer count.

    The window is half-open ``[since, until)``.
    """
    own = scope_to_owner(observations, roster_df)
    window = games
    if since is not None:
        window = window.filter(F.col("started_at") >= instant(since))
    if until is not None:
        window = window.filter(F.col("started_at") < instant(until))
    latest = latest_observations(own)
    observers = latest.groupBy("game_id").agg(F.count(F.lit(1)).alias("team_observers"))
    return latest.join(window, "game_id").join(observers, "game_id")


def matchup_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("member_id", "result", *DECK_COLUMNS, *QUEUE, "team_observers").agg(
        F.count(F.lit(1)).alias("games"))


def _pivot_outcomes(size: Column) -> list[Column]:
    return [F.sum(F.when(F.col("outcome") == o, size).otherwise(0)).alias(o)
            for o in OUTCOME_NAMES]


def matchup_report(counts: DataFrame, shown: DataFrame, team: bool = False, player=None,
                   opponent: str | None = None) -> DataFrame:
    """External games per deck pairing and queue; games seen by two members are left out.

    ``shown`` holds the configured members. Rows come ordered by games, player, decks, queue.
    """
    if opponent is not None and opponent not in COLOUR_PAIRS:
        raise ValueError("unknown opponent colour combination")
    rows = _matchup_rows(counts, shown, player, opponent).filter(F.col("team_observers") <= 1)
    who = [] if team else ["member_id", "preferred_display_name"]
    keys = [*who, "ours", "theirs", *QUEUE]
    out = rows.groupBy(*keys).agg(*_pivot_outcomes(F.col("games")), F.sum("games").alias("games"))
    out = out.withColumn("queue", queue_label()).drop(*QUEUE)
    return out.orderBy(F.col("games").desc(), *([] if team else ["preferred_display_name"]),
                       "ours", "theirs", "queue")


def internal_games(counts, shown, player=None, opponent=None) -> DataFrame:
    """Observations of team-against-team games that the report leaves out."""
    return _matchup_rows(counts, shown, player, opponent).filter(
        F.col("team_observers") > 1).agg(
        F.coalesce(F.sum("games"), F.lit(0)).alias("internal_games"))


def _matchup_rows(counts, shown, player, opponent):
    rows = counts.join(shown.select("member_id", "preferred_display_name"), "member_id")
    rows = rows.withColumn("ours", color_pair("your_deck_colors")).withColumn(
        "theirs", color_pair("opponent_deck_colors")).withColumn(
        "outcome", normalize_outcome("result"))
    if player is not None:
        rows = rows.filter(F.col("member_id") == player)
    if opponent is not None:
        rows = rows.filter(F.col("theirs") == opponent)
    return rows


def weekly_by_member(counts: DataFrame, shown: DataFrame) -> DataFrame:
    """Outcome counts per member and deck; members without games keep one empty row."""
    decks = counts.withColumn("outcome", normalize_outcome("result")).groupBy(
        "member_id", color_pair("your_deck_colors").alias("colors")).agg(
        *_pivot_outcomes(F.col("games")), F.sum("games").alias("games"))
    return shown.select("member_id", "preferred_display_name").join(
        decks, "member_id", "left").fillna(0, [*OUTCOME_NAMES, "games"])


def opponent_records(counts: DataFrame, shown: DataFrame) -> DataFrame:
    """Pooled record per opposing colours; the share counts wins and losses only."""
    rows = scope_to_owner(counts, shown).withColumn("outcome", normalize_outcome("result"))
    out = rows.groupBy(color_pair("opponent_deck_colors").alias("colors")).agg(
        *_pivot_outcomes(F.col("games")), F.sum("games").alias("games"))
    decided = F.col("win") + F.col("loss")
    return out.withColumn("win_percentage",
                          F.when(decided > 0, 100.0 * F.col("win") / decided))


def opponent_extremes(records: DataFrame) -> DataFrame:
    """Most losses and worst share with all ties, three most played, Unknown apart.

    ``records`` has one row per colour set, so at most 64 rows: the windows without a
    partition are bounded. Shares are compared as doubles, exact for counts below 2^26.
    """
    known = F.col("colors") != "Unknown"
    everything = Window.partitionBy(known)
    popularity = everything.orderBy(F.col("games").desc(), "colors")
    marked = records.select(
        "*", F.max("loss").over(everything).alias("_most"),
        F.min("win_percentage").over(everything).alias("_worst"),
        F.row_number().over(popularity).alias("_popular"))
    kinds = F.filter(F.array(
        F.when(known & (F.col("loss") > 0) & (F.col("loss") == F.col("_most")), "most_losses"),
        F.when(known & (F.col("win_percentage") == F.col("_worst")), "worst_percentage"),
        F.when(known & (F.col("_popular") <= 3), "popular"),
        F.when(~known, "unknown")), lambda k: k.isNotNull())
    return marked.select(F.explode(kinds).alias("kind"), *records.columns)


# --- summary -----------------------------------------------------------------------------

def latest_evidence(observed: DataFrame, replays: DataFrame, parser_version: str,
                    projection_version: int) -> DataFrame:
    """Latest valid archive of each observation's account and game.

    The archive is chosen before its read model is looked at: a missing or old read model is
    pending and never replaced by an older archive.
    """
    valid = replays.filter((F.col("status") == "valid")
                           & (F.col("normalization_status") == "valid")
                           & (F.col("parser_version") == parser_version))
    picked = latest_per_key(
        observed.select("member_id", "account_id", "game_id").join(
            valid, ["account_id", "game_id"]),
        ["member_id", "game_id"],
        [F.col("fetched_at").desc(), F.col("created_at").desc(), F.col("normalization_id")])
    ready = F.col("projection_version").eqNullSafe(F.lit(projection_version))
    return picked.select(
        "member_id", "game_id", "normalization_id",
        F.when(ready, F.col("mulligan_count")).alias("mulligan_count"),
        (~ready).alias("projection_pending"))


def member_summary(results: DataFrame, evidence: DataFrame, shown: DataFrame) -> DataFrame:
    """Games, most played known colours with ties, mean mulligan, pending read models."""
    rows = results.join(evidence, ["member_id", "game_id"], "left").withColumn(
        "colors", color_pair("your_deck_colors"))
    totals = rows.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("games"), F.avg("mulligan_count").alias("mulligan_average"),
        F.count("mulligan_count").alias("sample"),
        F.count_if("projection_pending").alias("pending"))
    per_colour = rows.filter(F.col("colors") != "Unknown").groupBy("member_id", "colors").agg(
        F.count(F.lit(1)).alias("n"))
    known = per_colour.groupBy("member_id").agg(F.sum("n").alias("known_colors"))
    # At most 63 colour sets per member, so the list is bounded.
    top = mode_with_ties(per_colour, ["member_id"], "n").groupBy("member_id").agg(
        F.max("n").alias("top_count"),
        F.array_join(F.array_sort(F.collect_list("colors")), ", ").alias("top_colors"))
    return (
        shown.select("slug", "member_id", "preferred_display_name")
        .join(totals, "member_id", "left").join(known, "member_id", "left")
        .join(top, "member_id", "left")
        .fillna(0, ["games", "sample", "pending", "known_colors", "top_count"])
    )


# --- practice ----------------------------------------------------------------------------

def practice_history(results: DataFrame, evidence: DataFrame, now: dt.datetime, days: int = 30,
                     ranked: bool | None = None, limit: int | None = None) -> DataFrame:
    """Games of every member in the window; with ``limit`` the newest ones of each (a report cap).

    Deduplication comes before the cap, and deck or colour filters after it. With a cap,
    ``game_rank`` numbers a member's games and ``truncated`` tells whether there were more.
    """
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    start = now - dt.timedelta(days=days)
    rows = results.filter((F.col("started_at") >= instant(start)) & (F.col("started_at") <= instant(now)))
    if ranked is not None:
        rows = rows.filter(F.col("ranked") == ranked)
    if limit is not None:
        newest = top_per_key(rows, ["member_id"], [F.desc("started_at"), F.asc("game_id")], limit + 1, "game_rank")
        beyond = newest.groupBy("member_id").agg((F.max("game_rank") > limit).alias("truncated"))
        rows = newest.filter(F.col("game_rank") <= limit).join(beyond, "member_id")
    return (
        rows.join(evidence.select("member_id", "game_id", "normalization_id", "mulligan_count"),
              ["member_id", "game_id"], "left")
        .withColumn("deck_label", colors_label("your_deck_colors"))
        .withColumn("outcome", normalize_outcome("result"))
    )


PROFILES = {"general": None, "ruby_sapphire": "Ruby/Sapphire"}
DECK_ID = re.compile("[0-9a-f]{12,64}")


def check_targets(cards: str | None) -> list[str]:
    """One to eight distinct comma-separated card names or ids, 300 characters in all."""
    if cards is None:
        return []
    names = list(dict.fromkeys(c.strip() for c in cards.split(",") if c.strip()))
    if not 1 <= len(names) <= 8 or len(cards) > 300:
        raise ValueError("give 1 to 8 comma-separated cards (300 characters at most)")
    return names


def practice_filter(history: DataFrame, deck: str | None = None, profile: str = "general") -> DataFrame:
    """Deck-id prefix and colour profile, applied to the history.

    A prefix that fits several decks of one member is an error when the rows are read;
    ``ambiguous_prefixes`` lists such prefixes.
    """
    if profile not in PROFILES:
        raise ValueError("unknown opening profile")
    rows = history
    if deck:
        prefix = deck.strip().lower()
        if not DECK_ID.fullmatch(prefix):
            raise ValueError("a deck id prefix has at least 12 hex digits")
        rows = rows.filter(F.col("deck_id").startswith(prefix))
        single = rows.groupBy("member_id").agg(
            (F.min("deck_id") == F.max("deck_id")).alias("_one"))
        error = F.raise_error(F.lit("the deck id prefix fits several decks; give more digits")).cast("boolean")
        rows = rows.join(single, "member_id").filter(F.when(F.col("_one"), True).otherwise(error)).drop("_one")
    if PROFILES[profile]:
        rows = rows.filter(F.col("deck_label") == PROFILES[profile])
    return rows


def opening_sample(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Games with evidence; with ``limit`` the newest ones per member (a report cap)."""
    rows = history.filter(F.col("normalization_id").isNotNull())
    return rows if limit is None else top_per_key(rows, ["member_id"], [F.desc("started_at"), F.asc("game_id")], limit)


def ambiguous_prefixes(decks: DataFrame, prefix_length: int = 12) -> DataFrame:
    """Deck-id prefixes shared by more than one deck of the same member."""
    return decks.filter(F.col("deck_id").isNotNull()).groupBy(
        "member_id", F.substring("deck_id", 1, prefix_length).alias("prefix")).agg(
        F.count_distinct("deck_id").alias("decks")).filter(F.col("decks") > 1)


def practice_record(history: DataFrame, keys: list[str]) -> DataFrame:
    return history.groupBy(*keys).agg(*wld_record(F.col("outcome")))


def opening_rates(metrics: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Share and known count of each yes/no metric; NULL leaves the denominator."""
    cols = []
    for f in flags:
        cols += [F.avg(F.col(f).cast("double")).alias(f"{f}_rate"), F.count(f).alias(f"{f}_known")]
    return metrics.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("openings"))


# --- team views --------------------------------------------------------------------------

def team_leaderboard(roster_df, links, current) -> DataFrame:
    """Every team's members by rating; only rated members get a rank, unrated come last.

    A team's order is total (rating, matches, id), so ranks come from the global numbering of
    (team, order) minus the team's first number; no team is sorted in one task.
    """
    from matchloom.operators.ordered import assign_sequence
    linked = roster_df.join(
        links.filter(F.col("is_primary")).select("member_id", "player_id"), "member_id", "left")
    rows = linked.join(current, "player_id", "left").withColumn("rated", F.col("rating").isNotNull())
    numbered = assign_sequence(rows, [
        F.col("slug"), F.col("rated").desc(), F.col("rating").desc(),
        F.col("matches_played").desc(), F.coalesce("player_id", F.lit(0)), F.col("member_id")], "_g")
    first = numbered.groupBy("slug").agg(F.min("_g").alias("_first"))
    return numbered.join(first, "slug").withColumn(
        "team_rank", F.when(F.col("rated"), F.col("_g") - F.col("_first") + 1)).drop(
        "_g", "_first", "rated")


def recent_team_events(roster_df, links, matches, events, start, end) -> DataFrame:
    """Events in the window with the roster players who took part, one row per player.

    Kept as rows, not as a list per event, so an event of any size stays spread out.
    """
    window = events.filter((F.col("start_datetime") >= instant(start))
                           & (F.col("start_datetime") <= instant(end)))
    sides = matches.select("event_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    seen = sides.filter(F.col("player_id").isNotNull()).join(
        window.select("event_id", "name", "start_datetime"), "event_id").distinct()
    own = links.filter(F.col("is_primary")).join(roster_df, "member_id").select(
        "slug", "player_id", "preferred_display_name")
    return seen.join(own, "player_id").select(
        "slug", "event_id", "name", "start_datetime", "player_id", "preferred_display_name")


def event_participants(registrations, matches) -> DataFrame:
    """Distinct players per event over registrations and both match sides."""
    sides = matches.select("event_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    everyone = registrations.select("event_id", "player_id").unionByName(
        sides.filter(F.col("player_id").isNotNull())).distinct()
    return everyone.groupBy("event_id").agg(F.count(F.lit(1)).alias("players"))


# --- usage and status --------------------------------------------------------------------

def usage_summary(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, distinct users, failures, prefix use and rounded mean duration.

    Distinct users come from one (key, user) row each, so the count never carries a set of
    users through a single task.
    """
    per_user = usage.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("succeeded")).alias("bad"),
        F.count_if(F.col("invocation_mode") == "prefix").alias("prefixed"),
        F.sum("duration_ms").alias("ms"))
    return per_user.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.count("user_id").alias("users"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("prefixed"), F.lit(0)).alias("prefix_uses"),
        F.bround(F.sum("ms") / F.sum("n")).cast("long").alias("average_ms"),
        F.when(F.sum("n") > 0, 100.0 * (F.sum("n") - F.sum("bad")) / F.sum("n"))
        .otherwise(100.0).alias("success_rate"))


def status_counts(matches: DataFrame) -> DataFrame:
    """Match counts by participants in one scan; unknown is a category of its own."""
    n = F.col("participant_count")
    return matches.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n == 2).alias("two_player"),
        F.count_if(n > 2).alias("multi"), F.count_if(n.isNull()).alias("unknown"))
