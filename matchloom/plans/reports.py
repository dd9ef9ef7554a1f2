"""End-user reports: one function per question, composed from the plans.

A report takes a ``Library`` of input frames and returns DataFrames; nothing is collected.
Point questions (one player, one viewer) are filters on plans that answer for everybody.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import long_words
from matchloom.functions.times import instant
from matchloom.plans import cards, games, periods, ratings, timeline
from matchloom.plans.retrieval import retrieve_pages


@dataclass(frozen=True)
class Library:
    """Input frames of the reports; a report touches only those it needs."""
    players: DataFrame = None
    matches: DataFrame = None
    events: DataFrame = None
    rounds: DataFrame = None
    phases: DataFrame = None
    registrations: DataFrame = None
    stores: DataFrame = None
    members: DataFrame = None
    memberships: DataFrame = None
    teams: DataFrame = None
    links: DataFrame = None
    accounts: DataFrame = None
    observations: DataFrame = None
    games: DataFrame = None
    replays: DataFrame = None
    usage: DataFrame = None
    run: ratings.Run = None
    parser_version: str = "parser_v1"
    projection_version: int = 1

    def roster(self, slug: str | None = None) -> DataFrame:
        rows = games.roster(self.members, self.memberships, self.teams)
        return rows.filter(F.col("slug") == slug) if slug else rows

    def shown(self, slug: str | None = None) -> DataFrame:
        return games.configured(self.roster(slug), self.accounts)

    def results(self, slug=None, since=None, until=None) -> DataFrame:
        return games.game_results(self.observations, self.games, self.roster(slug), since, until)


def player(lib: Library, query: str) -> DataFrame:
    """Profiles of the players a search finds (none, one or several)."""
    found = ratings.search_players(lib.players, lib.run.current, query).select("player_id")
    profile = ratings.player_profile(lib.run.current, lib.run.history, lib.players)
    return profile.join(found, "player_id", "left_semi")


def player_history(lib: Library, query: str) -> DataFrame:
    """Tournament history per event of the players a search finds, newest event first."""
    found = ratings.search_players(lib.players, lib.run.current, query).select("player_id")
    first = lib.matches.join(found.withColumnRenamed("player_id", "player1_id"), "player1_id", "left_semi")
    second = lib.matches.join(found.withColumnRenamed("player_id", "player2_id"), "player2_id", "left_semi")
    own = first.unionByName(second).dropDuplicates(["match_id"])
    rows = ratings.entity_history(own, lib.events, lib.rounds, lib.phases, lib.registrations,
                                  lib.players, lib.run.inputs)
    rolled = ratings.event_rollup(rows.join(found, "player_id", "left_semi"))
    return rolled.join(lib.events.select("event_id", "name", "start_datetime"), "event_id").orderBy(
        F.col("start_datetime").desc_nulls_last(), F.col("event_id").desc())


def leaderboard(lib: Library, minimum_matches: int = 20, limit: int = 25) -> DataFrame:
    return ratings.leaderboard(lib.run.current, lib.players, limit, 0, minimum_matches)


def team_leaderboard(lib: Library, slug: str, now: dt.datetime, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Members by rating, and the players of the events of the last ``days`` calendar days."""
    roster = lib.roster(slug)
    start = now.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=days - 1)
    return (games.team_leaderboard(roster, lib.links, lib.run.current),
            games.recent_team_events(roster, lib.links, lib.matches, lib.events, start, now))


def command_stats(lib: Library, now: dt.datetime, days: int = 30) -> tuple[DataFrame, DataFrame]:
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    recent = lib.usage.filter(F.col("occurred_at") >= instant(now - dt.timedelta(days=days)))
    return (games.usage_summary(recent, ["command_name"]).orderBy(F.col("uses").desc(), "command_name"),
            games.usage_summary(recent, []))


def database_status(lib: Library) -> DataFrame:
    return games.status_counts(lib.matches)


def championships(lib: Library, column: str, places: list[str], name: str) -> DataFrame:
    return periods.search_by_location(lib.events, lib.stores, column, places, name)


def weekly(lib: Library, slug: str, start: dt.datetime, end: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, opponents and coverage of one week [start, end); counts include team games."""
    shown = lib.shown(slug)
    counts = games.matchup_counts(lib.results(slug, start, end))
    return (games.weekly_by_member(counts, shown),
            games.opponent_extremes(games.opponent_records(counts, shown)),
            games.coverage(shown, lib.accounts))


def team_summary(lib: Library, slug: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
    results = lib.results(slug, since, until)
    evidence = games.latest_evidence(results, lib.replays, lib.parser_version, lib.projection_version)
    return games.member_summary(results, evidence, lib.shown(slug)).orderBy(
        F.lower("preferred_display_name"), "member_id")


def matchups(lib: Library, slug: str, since: dt.datetime, until: dt.datetime, team: bool = False,
             member=None, opponent: str | None = None) -> DataFrame:
    """Observers count over the whole roster; rows are shown for configured members."""
    counts = games.matchup_counts(lib.results(slug, since, until))
    return games.matchup_report(counts, lib.shown(slug), team, member, opponent)


def practice(lib: Library, slug: str, now: dt.datetime, days: int = 30, ranked: bool | None = None,
             deck: str | None = None, profile: str = "general",
             limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """History after its filters, and the record per member and deck label.

    ``limit`` shows the newest games of a member only, counted before the filters.
    """
    results = lib.results(slug)
    evidence = games.latest_evidence(results, lib.replays, lib.parser_version, lib.projection_version)
    rows = games.practice_filter(games.practice_history(results, evidence, now, days, ranked, limit), deck, profile)
    return rows, games.practice_record(rows, ["member_id", "deck_label"])


def review_plan(actions: DataFrame, perspective: int, refs: DataFrame, catalog: DataFrame,
                aliases: DataFrame, pages: DataFrame, turns: list[int] | None = None) -> dict[str, DataFrame]:
    """Selected turns, own action statistics, card decisions, durations and rule pages per game.

    Cards, durations and pages are those of the selected turns only.
    """
    picked = timeline.select_turns(actions, perspective, turns)
    used = refs.join(picked.select("game_id", "card_id").distinct(), ["game_id", "card_id"], "left_semi")
    decisions = cards.resolve_entities(used, catalog, aliases)
    facts = cards.evidence_cards(used, decisions).join(
        catalog.select(F.col("card_id").alias("canonical_card_id"), "name", "rules_text"),
        "canonical_card_id")
    # Words and names are made distinct before they are gathered, so a request is bounded by
    # the vocabulary and not by how often its cards occur.
    words = facts.select("game_id", F.explode(long_words(F.col("rules_text"))).alias("w")).distinct()
    terms = words.groupBy(F.col("game_id").alias("request_id")).agg(F.collect_set("w").alias("terms"))
    named = facts.select(F.col("game_id").alias("request_id"), "name").distinct().groupBy(
        "request_id").agg(F.collect_set("name").alias("names"))
    requests = terms.join(named, "request_id")
    return {
        "actions": picked, "statistics": timeline.action_counts(actions, perspective),
        "cards": cards.evidence_cards(used, decisions),
        "durations": facts.filter(cards.expires_next_turn()).select("game_id", "card_id", "name"),
        "pages": retrieve_pages(requests, pages),
    }


__all__ = ["Library", "championships", "command_stats", "database_status", "leaderboard", "matchups",
           "player", "player_history", "practice", "review_plan", "team_leaderboard", "team_summary",
           "weekly"]
