"""Nested tournament documents (JSON text) to typed tables.

Every function takes a frame with an id column and a ``body`` column of JSON text and works
row by row with ``from_json`` and ``explode``; no key is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.times import parse_timestamp
from matchloom.operators.keyed import top_per_key

EVENT = """id long, name string, start_datetime string, end_datetime string, timezone string,
 event_type string, event_format string, display_status string, event_status string,
 starting_player_count int, registered_user_count int, capacity int, event_is_online boolean,
 gameplay_format struct<id:string,name:string>, settings struct<event_lifecycle_status:string>,
 store struct<id:string,name:string,city:string,state:string,country:string,full_address:string,
  latitude:double,longitude:double,email:string,website:string>,
 tournament_phases array<struct<id:long,phase_name:string,order_in_phases:int,round_type:string,
  status:string,rounds:array<struct<id:long,round_number:int,round_type:string,status:string,
  pairings_status:string,standings_status:string,final_round_in_event:boolean>>>>"""
_STATUS = """struct<id:long,best_identifier:string,registration_status:string,matches_won:int,
 matches_lost:int,matches_drawn:int,total_match_points:int>"""
STANDINGS = f"array<struct<rank:int,player:struct<id:long,best_identifier:string>,user_event_status:{_STATUS}>>"
MATCH = f"""id long, status string, table_number int, winning_player string, games_won_by_winner int,
 games_won_by_loser int, match_is_intentional_draw boolean, match_is_unintentional_draw boolean,
 match_is_bye boolean, match_is_loss boolean, is_ghost_match boolean, is_feature_match boolean,
 created_at string, updated_at string,
 player_match_relationships array<struct<player:struct<id:long,best_identifier:string>,
  user_event_status:{_STATUS}>>"""


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def flatten_events(docs: DataFrame) -> dict[str, DataFrame]:
    """(event_id, body) to stores, events, phases, rounds and rejects.

    A document without an id, or with another event's id, is a reject with a reason.
    """
    parsed = docs.withColumn("e", F.from_json("body", EVENT))
    reason = F.when(F.col("e.id").isNull(), "missing_id").when(
        F.col("e.id") != F.col("event_id"), "wrong_event")
    rejects = parsed.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "event_id", "reason", "body")
    good = parsed.filter(reason.isNull())
    e = good.select("event_id", "e.*")
    stores = e.filter(F.col("store.id").isNotNull()).select(
        F.col("store.id").alias("store_id"),
        F.when(F.col("store.name") != "", F.col("store.name")).otherwise(
            F.concat(F.lit("Store "), F.col("store.id"))).alias("name"),
        F.col("store.city").alias("city"), F.col("store.state").alias("state_region"),
        F.col("store.country").alias("country"), "event_id")
    stores = top_per_key(stores, ["store_id"], [F.col("event_id").desc()]).drop("event_id")
    events = e.select(
        "event_id", F.col("store.id").alias("store_id"),
        F.when(F.col("name") != "", F.col("name")).otherwise(
            F.concat(F.lit("Event "), F.col("event_id").cast("string"))).alias("name"),
        parse_timestamp("start_datetime").alias("start_datetime"),
        parse_timestamp("end_datetime").alias("end_datetime"), "timezone",
        F.col("gameplay_format.id").alias("gameplay_format_id"),
        F.col("gameplay_format.name").alias("format"), "event_format",
        F.col("event_type").alias("category"), "display_status", "event_status",
        F.col("settings.event_lifecycle_status").alias("lifecycle_status"),
        F.col("starting_player_count").alias("player_count"), "registered_user_count",
        "capacity", "event_is_online")
    phase = e.select("event_id", F.posexplode_outer("tournament_phases").alias("phase_pos", "p")).filter(
        F.col("p.id").isNotNull())
    phases = phase.select(
        F.col("p.id").alias("phase_id"), "event_id", F.col("p.phase_name").alias("phase_name"),
        F.col("p.order_in_phases").alias("phase_order"), F.col("p.round_type").alias("round_type"),
        F.col("p.status").alias("status"))
    rounds = phase.select(
        "event_id", F.col("p.id").alias("phase_id"), F.col("p.phase_name").alias("phase_name"),
        "phase_pos", F.posexplode_outer("p.rounds").alias("round_pos", "r")).filter(
        F.col("r.id").isNotNull()).select(
        F.col("r.id").alias("round_id"), "event_id", "phase_id", "phase_name",
        F.col("r.round_number").alias("round_number"), F.col("r.round_type").alias("round_type"),
        F.col("r.status").alias("status"), F.col("r.pairings_status").alias("pairings_status"),
        F.col("r.standings_status").alias("standings_status"),
        F.coalesce("r.final_round_in_event", F.lit(False)).alias("final_round_in_event"),
        "phase_pos", "round_pos")
    return {"stores": stores, "events": events, "phases": phases, "rounds": rounds,
            "rejects": rejects}


def rounds_with_matches(rounds: DataFrame) -> DataFrame:
    return rounds.filter((F.col("round_type") == "PLAY_VS_OPPONENT")
                         & (F.col("pairings_status") == "GENERATED"))


def latest_standings_round(rounds: DataFrame) -> DataFrame:
    """Last round in document order whose standings were generated, per event."""
    return top_per_key(rounds.filter(F.col("standings_status") == "GENERATED"), ["event_id"],
                       [F.col("phase_pos").desc(), F.col("round_pos").desc()])


def flatten_standings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, body) with a JSON list to players and registrations.

    Rows without a player are skipped; a row without a registration keeps its player. The
    last row of a player wins.
    """
    rows = docs.select("event_id", F.posexplode_outer(F.from_json("body", STANDINGS)).alias("pos", "s"))
    rows = rows.filter(F.col("s.player.id").isNotNull())
    status = "s.user_event_status"
    players = top_per_key(rows.select(
        F.col("s.player.id").alias("player_id"),
        F.col("s.player.best_identifier").alias("display_name"),
        F.col(f"{status}.best_identifier").alias("username"), "event_id", "pos"),
        ["player_id"], [F.col("event_id").desc(), F.col("pos").desc()]).drop("event_id", "pos")
    registrations = rows.filter(F.col(f"{status}.id").isNotNull()).select(
        F.col(f"{status}.id").alias("registration_id"), "event_id",
        F.col("s.player.id").alias("player_id"),
        F.col(f"{status}.best_identifier").alias("display_name_at_event"),
        F.col(f"{status}.registration_status").alias("registration_status"),
        F.col(f"{status}.matches_won").alias("matches_won"),
        F.col(f"{status}.matches_lost").alias("matches_lost"),
        F.col(f"{status}.matches_drawn").alias("matches_drawn"),
        F.col(f"{status}.total_match_points").alias("match_points"),
        F.col("s.rank").alias("placement"))
    return players, registrations


def registrations_from_pairings(matches: DataFrame, rounds: DataFrame,
                                registrations: DataFrame) -> DataFrame:
    """Before standings exist: players paired in each event's latest paired round."""
    paired = matches.select("event_id", "round_id").distinct().join(
        rounds.select("round_id", "phase_pos", "round_pos"), "round_id")
    last = top_per_key(paired, ["event_id"], [F.col("phase_pos").desc(), F.col("round_pos").desc()])
    sides = matches.join(last.select("round_id"), "round_id", "left_semi").select(
        "event_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    known = registrations.select("event_id").distinct()
    return sides.filter(F.col("player_id").isNotNull()).distinct().join(known, "event_id", "left_anti")


def flatten_matches(docs: DataFrame) -> DataFrame:
    """(event_id, round_id, body) to match rows; scores are turned towards the winner."""
    m = docs.select("event_id", "round_id", F.from_json("body", MATCH).alias("m")).select(
        "event_id", "round_id", "m.*").filter(F.col("id").isNotNull())
    ids = F.array_distinct(F.filter(F.transform(
        F.coalesce("player_match_relationships", F.from_json(F.lit("[]"), f"array<struct<player:struct<id:long,best_identifier:string>,user_event_status:{_STATUS}>>")),
        lambda r: r["player"]["id"]), lambda i: i.isNotNull()))
    winner = F.coalesce(F.expr("try_cast(winning_player as bigint)"),
                        F.get_json_object("winning_player", "$.id").cast("long"))
    m = m.withColumn("_ids", ids).withColumn("winner_id", winner)
    p1, p2 = F.get("_ids", F.lit(0)), F.get("_ids", F.lit(1))
    w, l_ = F.col("games_won_by_winner"), F.col("games_won_by_loser")
    won1, won2 = F.col("winner_id") == p1, F.col("winner_id") == p2
    draw = _flag("match_is_intentional_draw") | _flag("match_is_unintentional_draw") | (
        F.col("winner_id").isNull() & ~_flag("match_is_bye") & F.col("status").eqNullSafe(F.lit("COMPLETE")))
    return m.select(
        F.col("id").alias("match_id"), "event_id", "round_id", p1.alias("player1_id"),
        p2.alias("player2_id"), F.size("_ids").alias("participant_count"),
        F.when(won1, w).when(won2, l_).alias("player1_score"),
        F.when(won1, l_).when(won2, w).alias("player2_score"), "winner_id", "status",
        "table_number", draw.alias("is_draw"),
        _flag("match_is_intentional_draw").alias("is_intentional_draw"),
        _flag("match_is_unintentional_draw").alias("is_unintentional_draw"),
        _flag("match_is_bye").alias("is_bye"), _flag("match_is_loss").alias("is_loss"),
        _flag("is_ghost_match").alias("is_ghost_match"),
        _flag("is_feature_match").alias("is_feature_match"),
        parse_timestamp("created_at").alias("created_at"),
        parse_timestamp("updated_at").alias("updated_at"))
