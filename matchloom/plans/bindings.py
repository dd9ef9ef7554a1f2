"""Domain views over the star-schema tables the library is exercised on.

Every view is a projection or a map-side combinable aggregate of the given tables, so its
cost grows with them and no key of theirs ends up whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom.session import spread

COLOURS = ["Amber", "Amethyst", "Emerald", "Ruby", "Sapphire", "Steel"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Read a table; its schema is taken from the files once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _mod(column, m: int) -> Column:
    return F.pmod(F.col(column) if isinstance(column, str) else column, F.lit(m))


def matches(spark, sf) -> DataFrame:
    """Two orders with neighbouring keys play each other; the higher total wins."""
    o = table(spark, sf, "orders").select(
        F.expr("o_orderkey div 2").alias("pair_id"),
        (_mod("o_orderkey", 2) == 0).alias("even"),
        F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"),
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"),
        (F.col("o_orderstatus") == "P").alias("open"))

    def side(flag, c, name):
        return F.max(F.when(F.col("even") == flag, F.col(c))).alias(name)
    paired = o.groupBy("pair_id").agg(
        side(True, "cust", "c1"), side(False, "cust", "c2"), side(True, "price", "x1"),
        side(False, "price", "x2"), side(True, "day", "d1"), side(False, "day", "d2"),
        side(True, "open", "o1"), side(False, "open", "o2"))
    pair = F.col("pair_id")
    single = F.col("c1").isNull() | F.col("c2").isNull()
    bye = single | (_mod(pair, 29) == 7)
    first = F.coalesce("c1", "c2")
    staged = paired.select(
        "pair_id", (pair * 2).alias("match_id"),
        F.coalesce("d1", "d2").cast("long").alias("event_id"),
        F.when(_mod(pair, 61) == 5, None).otherwise(first).alias("player1_id"),
        F.when(bye, None).otherwise(F.col("c2")).alias("player2_id"),
        bye.alias("is_bye"), (_mod(pair, 97) == 3).alias("is_ghost_match"),
        F.when(bye, 1).when(_mod(pair, 53) == 0, 3).when(_mod(pair, 59) == 0, None)
        .otherwise(2).cast("int").alias("participant_count"),
        F.when(_mod(pair, 89) == 0, None)
        .when(F.coalesce("o1", "o2") & (_mod(pair, 5) == 0), "PENDING")
        .otherwise("COMPLETE").alias("match_status"),
        (~bye & (F.abs(F.col("x1") - F.col("x2")) < 5000)).alias("close"),
        F.when(bye | (F.col("x1") >= F.col("x2")), first).otherwise(F.col("c2")).alias("best"),
        F.coalesce("x1", "x2").alias("price1"), F.col("x2").alias("price2"))
    lost_result, wrong = _mod(pair, 67) == 0, _mod(pair, 71) == 0
    draw = F.col("close") & ~lost_result & ~wrong
    return staged.select(
        "match_id", "event_id", (F.col("event_id") * 4 + _mod(pair, 4)).alias("round_id"),
        "player1_id", "player2_id",
        F.when(draw | lost_result, None).when(wrong, F.lit(-1)).otherwise(F.col("best"))
        .cast("long").alias("winner_id"),
        draw.alias("is_draw"), (draw & (_mod(pair, 2) == 0)).alias("is_intentional_draw"),
        "match_status", "is_bye", "is_ghost_match", "participant_count",
        (F.floor(F.col("price1") / 100000)).cast("int").alias("player1_score"),
        (F.floor(F.col("price2") / 100000)).cast("int").alias("player2_score"))


def events(spark, sf) -> DataFrame:
    """One tournament per order day."""
    day = table(spark, sf, "orders").select(
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
        .alias("event_id"), F.col("o_orderdate").alias("day")).distinct()
    e = F.col("event_id")
    start = F.col("day") + F.expr("interval 18 hours")
    status = F.array(*[F.lit(s) for s in
                       ["upcoming", "inProgress", "COMPLETE", " event_in_progress ", "live"]])
    return day.select(
        e, F.concat(F.lit("Event "), e.cast("string")).alias("name"),
        F.when(_mod(e, 73) == 0, None).otherwise(start).alias("start_datetime"),
        F.when(_mod(e, 31) == 0, None).otherwise(start + F.expr("interval 6 hours"))
        .alias("end_datetime"),
        F.when(_mod(e, 41) == 0, None).when(_mod(e, 7) < 4, "Core Constructed")
        .when(_mod(e, 7) < 6, "Infinity Constructed").otherwise("Draft").alias("format"),
        F.get(F.array(F.lit("America/New_York"), F.lit("UTC"), F.lit("Asia/Tokyo"),
                      F.lit("Nowhere/Zone"), F.lit(None).cast("string")),
              _mod(e, 5).cast("int")).alias("timezone"),
        F.when(_mod(e, 3) == 0, None).otherwise(F.get(status, _mod(e, 5).cast("int")))
        .alias("display_status"),
        F.get(status, _mod(e, 4).cast("int")).alias("event_status"),
        F.when(_mod(e, 6) == 0, "finished").otherwise("running").alias("lifecycle_status"),
        F.when(_mod(e, 37) == 0, "  ").otherwise(
            F.concat(F.lit("https://events.example/"), e.cast("string"))).alias("source_url"),
        _mod(e, 100).alias("store_id"),
        (start + F.expr("interval 3 hours")).alias("last_synced"))


def event_sync_state(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf).filter(_mod(e, 19) != 0).select(
        e, F.when(_mod(e, 17) == 0, "partial").when(_mod(e, 13) == 0, "failed")
        .when(_mod(e, 11) == 0, "importing").otherwise("complete").alias("state"),
        F.when(_mod(e, 5) == 0, None).otherwise(
            F.col("last_synced") - F.expr("interval 90 minutes")).alias("last_attempt_at"))


def rounds(spark, sf) -> DataFrame:
    e = events(spark, sf).select(
        "event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    rid = F.col("event_id") * 4 + F.col("r")
    return e.select(
        rid.alias("round_id"), "event_id", (F.col("r") + 1).alias("round_number"),
        (F.col("event_id") * 2 + F.floor(F.col("r") / 2)).alias("phase_id")
    ).filter(_mod("round_id", 43) != 0)


def phases(spark, sf) -> DataFrame:
    e = events(spark, sf).select(
        "event_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("phase_order"))
    return e.select(
        (F.col("event_id") * 2 + F.col("phase_order")).alias("phase_id"), "event_id",
        "phase_order",
        F.when(F.col("phase_order") == 0, "Swiss").otherwise("Top cut").alias("phase_name"))


def players(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("player_id"),
        F.when(_mod("c_custkey", 23) == 0, None).otherwise(F.col("c_name")).alias("display_name"),
        F.lower(F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")))
        .alias("username"))


def registrations(spark, sf) -> DataFrame:
    """Both sides of every match are registered; some carry a recorded result."""
    m = matches(spark, sf)
    sides = m.select("event_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    p, e = F.col("player_id"), F.col("event_id")
    return sides.filter(p.isNotNull()).distinct().select(
        e, p, (e * 10000000 + p).alias("registration_id"),
        F.when(_mod(p, 3) == 0, _mod(p, 5).cast("int")).alias("matches_won"),
        F.when(_mod(p, 3) == 0, _mod(p, 4).cast("int")).alias("matches_lost"),
        F.when(_mod(p, 3) == 0, F.lit(0)).alias("matches_drawn"),
        (_mod(p * 7 + e, 64) + 1).cast("int").alias("placement"),
        F.get(F.array(F.lit("ACTIVE"), F.lit(" complete "), F.lit("DROPPED")),
              _mod(p + e, 3).cast("int")).alias("registration_status"),
        F.expr("date_sub(date '1998-02-01', cast(player_id % 20 as int))").cast("timestamp_ntz")
        .alias("registration_synced"))


def teams(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("team_id"), F.lower("n_name").alias("slug"),
        F.col("n_name").alias("team_name"),
        F.when(_mod("n_nationkey", 5) == 4, "archived").otherwise("active").alias("status"))


def members(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("member_id"), F.col("c_name").alias("preferred_display_name"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("inactive").alias("status"))


def memberships(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("team_id"), F.col("c_custkey").alias("member_id"),
        F.when(_mod("c_custkey", 9) == 0, "captain").otherwise("member").alias("role"),
        F.when(_mod("c_custkey", 11) == 0, F.lit("2024-01-01").cast("timestamp_ntz"))
        .alias("ended_at"))


def player_links(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").filter(_mod("c_custkey", 13) != 0).select(
        F.col("c_custkey").alias("member_id"), F.col("c_custkey").alias("player_id"),
        (_mod("c_custkey", 7) != 0).alias("is_primary"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def accounts(spark, sf) -> DataFrame:
    """One account per event user; two users share a member."""
    u = F.col("account_id")
    per_user = table(spark, sf, "events").groupBy(F.col("user_id").alias("account_id")).agg(
        F.max("ts").alias("last_ts"))
    return per_user.select(
        u, F.expr("account_id div 2").alias("member_id"),
        F.when(_mod(u, 10) < 7, "active").when(_mod(u, 10) < 9, "auth_error")
        .otherwise("disabled").alias("status"),
        F.when(_mod(u, 17) == 0, None).when(_mod(u, 13) == 0, " env:  ")
        .when(_mod(u, 7) == 0, "vault:key")
        .otherwise(F.concat(F.lit(" env:KEY_"), u.cast("string"))).alias("credential_ref"),
        F.when(_mod(u, 5) != 0, F.col("last_ts")).alias("last_sync_completed_at"))


def observations(spark, sf) -> DataFrame:
    """What an account saw of a game; several accounts and members can see the same game."""
    k = F.col("k")
    colour = F.array(*[F.lit(c.lower()) for c in COLOURS])

    def pair(shift):
        i, j = _mod(k + shift, 6).cast("int"), _mod(F.expr("k div 6") + shift, 6).cast("int")
        return F.when(_mod(k + shift, 17) == 0, F.array(F.lit("grey"))).when(
            _mod(k + shift, 19) == 0, None).otherwise(F.array(F.get(colour, i), F.get(colour, j)))
    return table(spark, sf, "events").withColumn("k", _k()).select(
        F.col("user_id").alias("account_id"), F.expr("user_id div 2").alias("member_id"),
        F.expr("event_id div 4").alias("game_id"),
        F.get(F.array(F.lit("won"), F.lit("loss"), F.lit(" Tie "), F.lit("WIN"), F.lit("lost"),
                      F.lit("abandoned"), F.lit(None).cast("string")), _mod(k, 7).cast("int"))
        .alias("result"),
        F.when(_mod(k, 4) == 3, None).otherwise(_mod(k, 2) == 0).alias("went_first"),
        pair(0).alias("your_deck_colors"), pair(5).alias("opponent_deck_colors"),
        F.col("ts").alias("last_seen_at"), "event_id",
        F.concat(F.lit("r"), _mod("event_id", 7).cast("string")).alias("provider_replay_id"),
        F.when(_mod("event_id", 9) != 0, F.concat(F.lit("https://replays.example/"),
               F.col("event_id").cast("string"))).alias("replay_url"))


def games(spark, sf) -> DataFrame:
    g = F.col("game_id")
    return table(spark, sf, "events").groupBy(F.expr("event_id div 4").alias("game_id")).agg(
        F.min("ts").alias("started_at")).select(
        g, "started_at",
        F.get(F.array(F.lit("core-bo1"), F.lit("infinity-bo3"), F.lit("core_infinity"),
                      F.lit(None).cast("string")), _mod(g, 4).cast("int")).alias("queue_id"),
        F.when(_mod(g, 3) == 0, None).otherwise(F.lit("Core Constructed")).alias("queue_name"),
        F.when(_mod(g, 6) == 1, "casual").alias("mode"),
        F.get(F.array(F.lit("bo1"), F.lit("bo3"), F.lit(None).cast("string")),
              _mod(g, 3).cast("int")).alias("match_format"),
        F.when(_mod(g, 5) == 0, None).otherwise(_mod(g, 5) < 3).alias("ranked"))


def replays(spark, sf) -> DataFrame:
    """Stored archive versions per observation with their normalisation and read model."""
    i = F.col("event_id")
    return table(spark, sf, "events").withColumn("k", _k()).filter(_mod(i, 3) != 0).select(
        F.col("user_id").alias("account_id"), F.expr("event_id div 4").alias("game_id"),
        i.alias("replay_id"),
        F.when(_mod(i, 10) != 0, F.concat(F.lit("r"), _mod(i, 7).cast("string")))
        .alias("provider_replay_id"),
        F.when(_mod(i, 11) == 0, "invalid").otherwise("valid").alias("status"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("fetched_at"),
        (i * 10).alias("normalization_id"),
        F.when(_mod(i, 13) == 0, "invalid").otherwise("valid").alias("normalization_status"),
        F.when(_mod(i, 17) == 0, "parser_v0").otherwise("parser_v1").alias("parser_version"),
        (F.col("ts") + F.expr("interval 2 hours")).alias("created_at"),
        F.when(_mod(i, 5) == 0, None).otherwise(F.lit(1)).alias("projection_version"),
        F.when((_mod(i, 5) != 0) & (_mod(i, 7) != 0), _mod("k", 8).cast("int"))
        .alias("mulligan_count"))


def usage(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", _k()).select(
        F.col("ts").alias("occurred_at"), F.col("event_type").alias("command_name"),
        F.get(F.array(F.lit("slash"), F.lit("prefix"), F.lit("button")),
              _mod("k", 3).cast("int")).alias("invocation_mode"),
        "user_id", (F.col("value") >= 5).alias("succeeded"),
        (F.col("value") * 10).cast("int").alias("duration_ms"))


def catalog(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.cast("string").alias("card_id"),
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"),
                 F.when(_mod(p, 4) == 0, F.concat(F.lit("  – Édition "), F.expr("p_partkey div 8")
                                                  .cast("string"))).otherwise("")).alias("name"),
        F.when(_mod(p, 10) == 3, "promo").otherwise(_mod(p, 250).cast("string"))
        .alias("collector_number"),
        F.when(_mod(p, 21) == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.get(F.array(*[F.lit(c) for c in COLOURS]), _mod("p_size", 6).cast("int"))))
        .alias("ink_colors"),
        F.when(_mod(p, 33) == 0, None).otherwise(_mod("p_size", 10)).cast("int").alias("cost"),
        (_mod("p_size", 2) == 0).alias("inkable"),
        F.when(F.col("p_type") == "PROMO", "Location").when(F.col("p_type") == "SMALL", "Action")
        .otherwise("Character").alias("card_type"),
        F.array(F.col("p_type")).alias("classifications"),
        F.concat(F.lit("Gains 2 until the start of "),
                 F.when(_mod(p, 2) == 0, "your").otherwise("their"), F.lit(" next turn"))
        .alias("rules_text"),
        F.when(_mod(p, 12) == 0, None).otherwise(_mod("p_size", 7)).cast("int").alias("strength"),
        F.lit(3).alias("willpower"), _mod(p, 4).cast("int").alias("lore"),
        F.when(_mod(p, 2) == 0, F.lit(2)).alias("move_cost"), F.col("p_brand").alias("set_name"))


def actions(spark, sf) -> DataFrame:
    """Conversation turns read as an action log: user is player 1, assistant player 2.

    In every fifth turn the other player replies.
    """
    n = F.length("text")
    active = F.when(F.col("role") == "system", None).when(F.col("role") == "user", 1).otherwise(2)
    kind = F.array(*[F.lit(t) for t in
                     ["play", "quest", "ink", "challenge", "end_turn", "choice"]])
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("game_id"), F.col("turn").alias("seq"),
        active.alias("active_player"),
        F.when(_mod(F.col("turn"), 5) == 3, 3 - active).otherwise(active).alias("actor"),
        (F.expr("turn div 2") + 1).alias("turn_label"),
        F.when(_mod(n, 9) == 0, "undo").otherwise(F.get(kind, _mod(n, 6).cast("int")))
        .alias("type"),
        F.when(_mod(n, 3) == 0, None).otherwise(_mod(n, 500)).cast("string").alias("card_id"),
        n.alias("size"))


def card_references(spark, sf) -> DataFrame:
    """Cards named by order lines: some ids are unknown, some names differ or are missing."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    names = catalog(spark, sf).select(F.col("card_id"), F.col("name").alias("_name"))
    key, sup = F.col("l_partkey"), F.col("l_suppkey")
    rows = line.withColumn("card_id", key.cast("string")).join(names, "card_id")
    return rows.select(
        F.col("l_orderkey").alias("game_id"),
        F.when(_mod(key, 8) == 4, F.concat(F.lit("x-"), "card_id")).otherwise(F.col("card_id"))
        .alias("card_id"),
        F.when(_mod(key, 5) == 0, None).when((_mod(key, 7) == 0) & (_mod(sup, 3) == 0), "Other name")
        .otherwise(F.upper("_name")).alias("observed_name"))


def card_aliases(spark, sf) -> DataFrame:
    """Reviewed aliases: unknown id and the exact name it must have been seen with."""
    c, key = catalog(spark, sf), F.col("card_id").cast("long")
    return c.filter((_mod(key, 8) == 4) & (_mod(key, 3) != 0)).select(
        F.concat(F.lit("x-"), "card_id").alias("card_id"),
        F.when(_mod(key, 11) == 0, "No such card").otherwise(F.col("name")).alias("expected_name"))


def undo_log(spark, sf) -> DataFrame:
    """Event stream as one long action log per user; errors undo a span before them."""
    e = table(spark, sf, "events").withColumn("k", _k())
    undo = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"),
        F.when(undo, "undo").otherwise(F.col("event_type")).alias("type"),
        F.when(undo, F.col("event_id") - F.col("k") * 6).alias("target_seq"),
        F.when(_mod("k", 4) == 0, None).otherwise(F.col("k")).cast("int").alias("card_no"))


# --- documents -----------------------------------------------------------------------------

def event_documents(spark, sf) -> DataFrame:
    """One nested event document per part, some with a wrong or missing id."""
    p = F.col("p_partkey")

    def rnd(i, j):
        number = p * 10 + i * 4 + j
        return F.struct(
            F.when(~((_mod(p, 9) == 0) & (j == F.lit(1))), number).alias("id"), (j + 1).alias("round_number"),
            F.when(_mod(number, 5) == 0, "BYE_ROUND").otherwise("PLAY_VS_OPPONENT").alias("round_type"),
            F.lit("COMPLETE").alias("status"), F.lit("GENERATED").alias("pairings_status"),
            F.when(_mod(number, 3) == 0, "GENERATED").otherwise("NONE").alias("standings_status"),
            F.when(j == F.lit(2), True).alias("final_round_in_event"))
    phase = lambda i: F.struct(
        (p * 2 + i).alias("id"), F.concat(F.lit("Phase "), i.cast("string")).alias("phase_name"),
        i.alias("order_in_phases"), F.lit("SWISS").alias("round_type"), F.lit("DONE").alias("status"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: rnd(i, j)).alias("rounds"))
    body = F.struct(
        F.when(_mod(p, 50) == 7, None).when(_mod(p, 50) == 8, p + 1).otherwise(p).alias("id"),
        F.when(_mod(p, 6) != 0, F.col("p_name")).alias("name"),
        F.concat(F.lit("2026-01-0"), (_mod(p, 9) + 1).cast("string"),
                 F.when(_mod(p, 4) == 0, "T10:00:00+02:00").otherwise("T10:00:00Z")).alias("start_datetime"),
        F.when(_mod(p, 3) == 0, F.struct(_mod(p, 40).cast("string").alias("id"),
               F.when(_mod(p, 2) == 0, F.lit("The Store")).alias("name"))).alias("store"),
        F.struct(F.lit("7").alias("id"), F.col("p_type").alias("name")).alias("gameplay_format"),
        F.when(_mod(p, 5) == 0, None).otherwise(_mod(p, 2) == 0).alias("event_is_online"),
        F.transform(F.sequence(F.lit(0), F.lit(1)), phase).alias("tournament_phases"))
    return table(spark, sf, "part").select(p.alias("event_id"), F.to_json(body).alias("body"))


def match_documents(spark, sf) -> DataFrame:
    """One nested match document per order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rel = lambda i: F.struct(F.struct(i.alias("id"), F.lit("n").alias("best_identifier")).alias("player"))
    other = F.when(_mod(o, 7) == 0, c).otherwise(c + 1)
    body = F.struct(
        o.alias("id"), F.when(_mod(o, 4) == 0, "PENDING").otherwise("COMPLETE").alias("status"),
        F.when(_mod(o, 5) == 0, None).when(_mod(o, 2) == 0, F.to_json(F.struct(c.alias("id"))))
        .otherwise((c + 1).cast("string")).alias("winning_player"),
        F.lit(2).alias("games_won_by_winner"), _mod(o, 2).alias("games_won_by_loser"),
        F.when(_mod(o, 11) == 0, True).alias("match_is_intentional_draw"), (_mod(o, 13) == 0).alias("match_is_bye"),
        F.array(rel(c), rel(F.lit(None).cast("long")), rel(other), rel(c)).alias("player_match_relationships"))
    text = F.regexp_replace(F.to_json(body), r'"winning_player":"(\{.*?\}|\d+)"', r'"winning_player":$1')
    text = F.regexp_replace(text, r'"winning_player":\{\\"id\\":(\d+)\}', r'"winning_player":{"id":$1}')
    return table(spark, sf, "orders").select(
        _mod(o, 100).alias("event_id"), _mod(o, 400).alias("round_id"), text.alias("body"))


def standing_documents(spark, sf) -> DataFrame:
    """One standings list of three rows per order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    row = lambda i: F.struct(
        (i + 1).alias("rank"),
        F.struct(F.when(_mod(o + i, 5) != 0, c + _mod(i, 2)).alias("id"),
                 F.concat(F.lit("p"), (o * 3 + i).cast("string")).alias("best_identifier")).alias("player"),
        F.struct(F.when(_mod(o + i, 4) != 0, o * 10 + i).alias("id"), F.lit("u").alias("best_identifier"),
                 F.lit("COMPLETE").alias("registration_status"), i.alias("matches_won")).alias("user_event_status"))
    body = F.transform(F.sequence(F.lit(0), F.lit(2)), row)
    return table(spark, sf, "orders").select(o.alias("event_id"), F.to_json(body).alias("body"))


def history_documents(spark, sf) -> DataFrame:
    """One loosely typed game document per event row."""
    e, k = F.col("event_id"), F.col("k")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    iso = F.date_format(F.date_trunc("SECOND", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    started = F.when(_mod(k, 5) == 0, seconds).when(_mod(k, 5) == 1, F.concat(seconds, F.lit("000"))).when(
        _mod(k, 5) == 2, quote(F.concat(iso, F.lit("Z")))).when(_mod(k, 5) == 3, quote(iso)).otherwise(F.lit("null"))
    ranked = F.get(F.array(F.lit("true"), F.lit("0"), F.lit("null"), F.lit('"yes"')), _mod(k, 4).cast("int"))
    number = F.get(F.array(F.lit("1"), F.lit("true"), F.lit('"2"'), F.lit("null"), F.lit('"x"')), _mod(k, 7).cast("int"))
    colours = F.get(F.array(F.lit('"Ruby/ Steel"'), F.lit('["AMBER"," "]'), F.lit("null"), F.lit("[1]"), F.lit("7")),
                    _mod(k, 6).cast("int"))
    body = F.concat(
        F.lit('{"game_id":'), F.when(_mod(e, 31) == 0, F.lit('" "')).otherwise(quote(F.concat(F.lit(" g"), e.cast("string")))),
        F.lit(',"mode":"  ","result":'), quote(F.col("event_type")), F.lit(',"started_at":'), started,
        F.lit(',"ranked":'), ranked, F.lit(',"match_game_number":'), F.coalesce(number, F.lit("null")),
        F.lit(',"your_deck_colors":'), F.coalesce(colours, F.lit("null")), F.lit("}"))
    return table(spark, sf, "events").withColumn("k", _k()).select(e, body.alias("body"))


def hydrated_pages(spark, sf) -> DataFrame:
    """Every page with an event object pushed by scripts behind its own markup."""
    i = F.col("page_id")
    quoted = lambda c: F.expr("1") if c is None else F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)  # noqa: E731,E501
    event = F.to_json(F.struct(F.when(_mod(i, 7) == 0, i + 1000000).otherwise(i).alias("id"),
                               F.concat(F.lit('line "1"\n{x} '), F.col("url")).alias("name")))
    text = F.concat(F.lit('{"event":'), event, F.lit("} tail"))
    half = F.floor(F.length(text) / 2).cast("int")
    push = lambda c: F.concat(F.lit("<script>self.__next_f.push([1,"), quoted(c), F.lit("])</script>"))
    two = F.concat(push(text.substr(F.lit(1), half)), push(text.substr(half + 1, F.length(text))))
    scripts = F.when(_mod(i, 11) == 0, "<script>self.__next_f.push([1,</script>").when(
        _mod(i, 3) == 0, two).otherwise(push(text))
    return table(spark, sf, "pages").select(
        i, i.alias("event_id"), F.concat("html", scripts).alias("html"))


def archives(spark, sf) -> DataFrame:
    """One replay archive (JSON text) per order: 6 to 9 frames of every kind."""
    o = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    kind = lambda i: F.pmod(o + i, F.lit(6))
    hand = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: text(
        '{"id":"1-', i, '","instanceId":"h', i, '","name":"Card ', i, '","inkable":', F.when(i % 3 == 0, "false").otherwise("true"), "}")), ",")
    swap = F.when(_mod(o, 3) == 0, text(
        '{"op":"remove","path":"/myPlayer/hand/0"},{"op":"add","path":"/myPlayer/hand/-","value":'
        '{"id":"1-99","instanceId":"n1","name":"New"', F.when(_mod(o, 2) == 0, ',"inkable":false').otherwise(""), "}}")).otherwise("")
    drop = '{"op":"remove","path":"/myPlayer/hand/0"}'

    def frame(i):
        named = F.when(_mod(o, 2) == 0, F.lit('"cardId":"2-1","cardName":"Named"')).otherwise("")
        later = (
            F.when(kind(i) == 0, text('"actionType":"PLAY_CARD","takenAction":{', named, '},"patch":[', drop, "]"))
            .when(kind(i) == 1, text('"actionType":"QUEST","takenAction":{"loreGained":2},"patch":[{"op":"replace",'
                                     '"path":"/myPlayer/lore","value":', i * 2, "}]"))
            .when(kind(i) == 2, text('"actionType":"ADD_TO_INK","takenAction":{},"patch":[', drop, ',{"op":"add","path":'
                                     '"/myPlayer/inkwell/-","value":{"exerted":', F.when(i % 2 == 0, "true").otherwise("false"), "}}]"))
            .when(kind(i) == 3, text('"actionType":"ATTACK","takenAction":{"attackerCardId":"3-1","attackerName":"Att",'
                                     '"defenderCardId":"3-2","defenderBanished":', F.when(_mod(o, 2) == 0, "true").otherwise("false"),
                                     ',"attackerBanished":', F.when(_mod(o, 3) == 0, "true").otherwise("false"), '},"patch":[]'))
            .when(kind(i) == 4, text('"actionType":"END_TURN","takenAction":{},"patch":[{"op":"replace","path":"/turnNumber","value":', i,
                                     '},{"op":"replace","path":"/currentPlayer","value":', i % 2 + 1, '},{"op":"remove","path":"/absent"}]'))
            .otherwise(text('"actionType":"FREE_UNDO:', i - 1, '","patch":[]')))
        body = F.when(i == 0, text(
            '"actionType":"CHOOSE_STARTING_PLAYER","takenAction":{},"patch":[{"op":"replace","path":"/firstPlayer","value":',
            F.pmod(o, F.lit(2)) + 1, '},{"op":"replace","path":"/status","value":"playing"},{"op":"replace","path":"/turnNumber",'
            '"value":1},{"op":"replace","path":"/currentPlayer","value":1}]')).when(
            i == 1, text('"actionType":"MULLIGAN","takenAction":{},"patch":[', swap, "]")).otherwise(later)
        return text('{"seq":', i, ',"player":', F.when((i > 1) & (i % 3 == 0), 2).otherwise(1), ',"logCountAfter":', i + 1, ",", body, "}")

    def log(i):
        return F.when(kind(i) == 0, text('{"id":"l', i, '","type":"CARD_PLAYED","message":"Ann ', F.when(
            _mod(o, 5) == 0, "sang").otherwise("played"), ' it","cardRefs":[{"id":"5-', i, '","name":"Seen"}]}')).when(
            kind(i) == 3, text('{"id":"l', i, '","type":"CARD_ATTACK","message":"m","data":{"attackerBaseStrength":3,"actualDamageToDefender":', i, "}}")
        ).otherwise(text('{"id":"l', i, '","type":"NOTE"}'))
    last = (_mod(o, 4) + 5).cast("int")
    body = text('{"format":"', F.when(_mod(o, 17) == 0, "other").otherwise("duels-replay-v1"), '","gameId":"', o,
                '","perspective":1,"playerNames":{"1":"Ann"', F.when(_mod(o, 2) == 0, ',"2":"Bob"').otherwise(""), '},"baseSnapshotLogCount":0,"baseSnapshot":{"status":"mulligan",'
                '"turnNumber":0,"myPlayer":{"lore":0,"hand":[', hand, '],"inkwell":[]}},"frames":[',
                F.array_join(F.transform(F.sequence(F.lit(0), last), frame), ","), '],"logs":[',
                F.array_join(F.transform(F.sequence(F.lit(0), last), log), ","), "]}")
    keys = spread(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")  # the narrow rows, not the bodies
    return keys.select(o.alias("game_id"), body.alias("body"))


def ability_archives(spark, sf) -> DataFrame:
    """One replay archive per part: nine frames with an ability whose card comes late, prompts, a song, a challenge."""
    o = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    named = F.when(_mod(o, 7) == 0, F.lit('"cardId":"9-9","cardName":"Known"')).otherwise("")
    at = F.least(_mod(o, 5), F.lit(3)) + 2  # the frame whose logs name the ability
    hand = ",".join(f'{{"id":"1-{i}","instanceId":"h{i}","fullName":"Card {i}","cost":{i},"inkable":true}}' for i in range(7))
    fields = ('{"id":"3-1","instanceId":"a1","name":"Att","strength":3,"willpower":4,"exerted":false}',
              '{"id":"3-2","instanceId":"d1","name":"Def","strength":2,"willpower":2,"damage":1}')
    frames = [
        text('"player":1,"actionType":"', F.when(_mod(o, 10) == 9, "LATE_START").otherwise("CHOOSE_STARTING_PLAYER"),
             '","takenAction":{},"patch":[{"op":"replace","path":"/firstPlayer","value":', _mod(o, 2) + 1,
             '},{"op":"replace","path":"/status","value":"playing"},{"op":"replace","path":"/turnNumber","value":1},'
             '{"op":"replace","path":"/currentPlayer","value":1}]'),
        F.lit('"player":1,"actionType":"MULLIGAN","takenAction":{},"patch":[]'),
        text('"player":1,"actionType":"ACTIVATE_ABILITY","takenAction":{', named, '},"patch":[]'),
        F.lit('"player":2,"actionType":"RESPOND_TO_PROMPT","takenAction":{},"patch":[]'),
        text('"player":1,"actionType":"', F.when(_mod(o, 5) == 4, "QUEST").otherwise("RESPOND_TO_PROMPT"),
             '","takenAction":{"loreGained":2,"newLoreTotal":5},"patch":[]'),
        F.lit('"player":2,"actionType":"RESPOND_TO_PROMPT","takenAction":{},"patch":[]'),
        F.lit('"player":1,"actionType":"PLAY_CARD","takenAction":{"source":"hand","cardType":"song"},"patch":[]'),
        text('"player":1,"actionType":"ATTACK","takenAction":{"attackerCardId":"3-1","attackerInstanceId":"a1","attackerName":"Att",'
             '"defenderCardId":"3-2","defenderInstanceId":"d1","defenderName":"Def","damageToDefender":3,"damageToAttacker":2,'
             '"defenderBanished":', F.when(_mod(o, 2) == 0, "true").otherwise("false"), '},"patch":[', F.when(_mod(o, 2) == 0, text(
                 '{"op":"remove","path":"/opponent/field/0"},{"op":"add","path":"/opponent/discard/-","value":', fields[1], "}")
             ).otherwise('{"op":"replace","path":"/opponent/field/0/damage","value":2}'), "]"),
        F.lit('"player":1,"actionType":"END_TURN","takenAction":{},"patch":[{"op":"replace","path":"/turnNumber","value":2},'
              '{"op":"replace","path":"/currentPlayer","value":2},{"op":"replace","path":"/winner","value":1}]')]
    choice = lambda i: text('"type":"CHOICE_RESOLVED","message":"Bob chose \\"Left ', F.lit(i), '\\"","cardRefs":[',
                            F.when(_mod(o, 3) != 0, text('{"id":"7-', F.lit(i), '","name":"Pick"}')).otherwise(""), "]")
    ability = text('"type":"ABILITY_ACTIVATED","player":1,"message":"Ann activated Glow on Lamp","cardRefs":[{"id":"8-',
                   _mod(o, 3), '","name":"Lamp"}]')
    logs = [F.lit('"type":"NOTE"'), text('"type":"MULLIGAN","player":1,"data":{"mulliganCount":',
                                         F.when(_mod(o, 6) == 0, 1).otherwise(0), "}")]
    logs += [F.when(at == i, ability).otherwise(choice(i) if i > 2 else F.lit('"type":"NOTE"')) for i in range(2, 6)]
    logs += [F.lit('"type":"CARD_PLAYED","message":"Ann sang it","cardRefs":[{"id":"5-6","name":"Song"},{"id":"5-7","name":"Singer"}]'),
             text('"type":"CARD_ATTACK","message":"hit","data":{"attackerBaseStrength":3,"attackerChallengerBonus":', _mod(o, 4),
                  ',"actualDamageToDefender":3,"defenderTotalDamage":', _mod(o, 4) + 3, "}"), F.lit('"type":"NOTE"')]
    prompt = ('{"id":"q1","type":"CHOOSE","message":"Pick","required":true,"minSelect":1,"maxSelect":2,'
              '"validTargets":["h1"],"sourceAbility":"Glow"}')
    body = text('{"format":"duels-replay-v1","gameId":"', o, '","perspective":1,"winner":', F.when(_mod(o, 4) == 0, 2).otherwise(1),
                ',"victoryReason":"lore","turnCount":2,"playerNames":{"1":"Ann","2":"Bob"},"decklist":["1-0","3-1"],'
                '"baseSnapshotLogCount":0,"baseSnapshot":{"status":"mulligan","turnNumber":0,"firstPlayer":2,"replayId":"rp', o,
                f'","promptSourceCard":{{"id":"9-1","name":"Src"}},"pendingPrompts":[{prompt}],"opponentHasPendingPrompts":true,'
                f'"myPlayer":{{"lore":3,"deckCount":53,"hand":[{hand}],"field":[{fields[0]}],"inkwell":[]}},'
                f'"opponent":{{"lore":1,"handCount":6,"field":[{fields[1]}],"discard":[]}}}},"frames":[',
                F.concat_ws(",", *[text('{"seq":', F.lit(i), ',"logCountAfter":', F.lit(i + 1), ",", f, "}") for i, f in enumerate(frames)]),
                '],"logs":[', F.concat_ws(",", *[text('{"id":"l', F.lit(i), '",', log, "}") for i, log in enumerate(logs)]), "]}")
    keys = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    return keys.select(o.alias("game_id"), body.alias("body"))
