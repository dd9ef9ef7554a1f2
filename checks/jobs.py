"""Document, archive and conversion jobs."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from checks.base import query
from matchloom.plans import bindings as b
from matchloom.plans import features as ft
from matchloom.plans import timeline as t
from matchloom.plans.bindings import table
from matchloom.session import materialize, scratch_path
from matchloom.sources import archives as a
from matchloom.sources import catalogs as cat
from matchloom.sources import conform as cf
from matchloom.sources import documents as doc
from matchloom.sources import loads
from matchloom.sources.history import parse_history
from matchloom.sources.pages import extract_embedded_json

GOOD = "from part where p_partkey % 50 not in (7, 8)"


@query("flatten_events", f"""select p_partkey as event_id, case when p_partkey % 6 = 0 then 'Event ' || p_partkey else p_name end as name, case when p_partkey % 3 = 0 then (p_partkey % 40)::varchar end as store_id, p_type as format,
 epoch(timestamp '2026-01-01 10:00:00' + to_days((p_partkey % 9)::int) - case when p_partkey % 4 = 0 then interval 2 hour else interval 0 hour end)::bigint as start_epoch, case when p_partkey % 5 = 0 then null else p_partkey % 2 = 0 end as event_is_online {GOOD}""")
def flatten_events(spark, sf):
    e = doc.flatten_events(b.event_documents(spark, sf))["events"]
    return e.select("event_id", "name", "store_id", "format",
                    F.unix_seconds("start_datetime").alias("start_epoch"), "event_is_online")


@query("flatten_event_stores", f"""select store_id, name from (select (p_partkey % 40)::varchar as store_id, case when p_partkey % 2 = 0 then 'The Store' else 'Store ' || (p_partkey % 40) end as name, row_number() over (partition by p_partkey % 40 order by p_partkey desc) as n {GOOD} and p_partkey % 3 = 0) where n = 1""")
def flatten_event_stores(spark, sf):
    return doc.flatten_events(b.event_documents(spark, sf))["stores"].select("store_id", "name")


ROUNDS = f"""select p_partkey * 10 + i * 4 + j as round_id, p_partkey as event_id, p_partkey * 2 + i as phase_id, 'Phase ' || i as phase_name, j + 1 as round_number,
 case when (p_partkey * 10 + i * 4 + j) % 5 = 0 then 'BYE_ROUND' else 'PLAY_VS_OPPONENT' end as round_type, case when (p_partkey * 10 + i * 4 + j) % 3 = 0 then 'GENERATED' else 'NONE' end as standings_status, j = 2 as final_round_in_event, i, j
 from (select *, unnest([0, 1]) as i {GOOD}) x, range(3) r(j) where not (p_partkey % 9 = 0 and j = 1)"""


@query("flatten_event_rounds", f"select round_id, event_id, phase_id, phase_name, round_number::int as round_number, round_type, standings_status, final_round_in_event from ({ROUNDS})")
def flatten_event_rounds(spark, sf):
    return doc.flatten_events(b.event_documents(spark, sf))["rounds"].select(
        "round_id", "event_id", "phase_id", "phase_name", "round_number", "round_type",
        "standings_status", "final_round_in_event")


@query("rounds_due", f"select round_id from ({ROUNDS}) where round_type = 'PLAY_VS_OPPONENT'")
def rounds_due(spark, sf):
    return doc.rounds_with_matches(doc.flatten_events(b.event_documents(spark, sf))["rounds"]).select("round_id")


@query("latest_standings_round", f"select event_id, round_id from (select *, row_number() over (partition by event_id order by i desc, j desc) as n from ({ROUNDS}) where standings_status = 'GENERATED') where n = 1")
def latest_standings_round(spark, sf):
    rounds = doc.flatten_events(b.event_documents(spark, sf))["rounds"]
    return doc.latest_standings_round(rounds).select("event_id", "round_id")


@query("flatten_event_rejects", "select p_partkey as event_id, case when p_partkey % 50 = 7 then 'missing_id' else 'wrong_event' end as reason from part where p_partkey % 50 in (7, 8)")
def flatten_event_rejects(spark, sf):
    return doc.flatten_events(b.event_documents(spark, sf))["rejects"].select("event_id", "reason")


@query("flatten_matches", """select match_id, player1_id, player2_id, n as participant_count, winner_id, case when winner_id = player1_id then 2 when winner_id = player2_id then l end::int as player1_score,
 case when winner_id = player1_id then l when winner_id = player2_id then 2 end::int as player2_score, is_bye, intentional or (winner_id is null and not is_bye and status = 'COMPLETE') as is_draw from (
 select o_orderkey as match_id, o_custkey as player1_id, case when o_orderkey % 7 = 0 then null else o_custkey + 1 end as player2_id, case when o_orderkey % 7 = 0 then 1 else 2 end as n,
 case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then o_custkey else o_custkey + 1 end as winner_id, o_orderkey % 2 as l, o_orderkey % 13 = 0 as is_bye, o_orderkey % 11 = 0 as intentional,
 case when o_orderkey % 4 = 0 then 'PENDING' else 'COMPLETE' end as status from orders)""")
def flatten_matches(spark, sf):
    return doc.flatten_matches(b.match_documents(spark, sf)).select(
        "match_id", "player1_id", "player2_id", "participant_count", "winner_id", "player1_score",
        "player2_score", "is_bye", "is_draw")


STAND = """select o_orderkey as event_id, i, case when (o_orderkey + i) % 5 <> 0 then o_custkey + i % 2 end as player_id, 'p' || (o_orderkey * 3 + i) as display_name, case when (o_orderkey + i) % 4 <> 0 then o_orderkey * 10 + i end as registration_id from orders, range(3) r(i)"""


@query("flatten_standings_players", f"select player_id, display_name from (select *, row_number() over (partition by player_id order by event_id desc, i desc) as n from ({STAND}) where player_id is not null) where n = 1")
def flatten_standings_players(spark, sf):
    return doc.flatten_standings(b.standing_documents(spark, sf))[0].select("player_id", "display_name")


@query("flatten_standings_registrations", f"select registration_id, event_id, player_id, (i + 1)::int as placement from ({STAND}) where player_id is not null and registration_id is not null")
def flatten_standings_registrations(spark, sf):
    return doc.flatten_standings(b.standing_documents(spark, sf))[1].select(
        "registration_id", "event_id", "player_id", "placement")


PAIRED = """select (o_orderkey % 100) as event_id, (o_orderkey % 400) as round_id, o_custkey as p1, case when o_orderkey % 7 = 0 then null else o_custkey + 1 end as p2 from orders"""


@query("pairing_registrations", f"""with last as (select event_id, max(round_id) as round_id from ({PAIRED}) group by 1), s as (select p.event_id, unnest([p1, p2]) as player_id from ({PAIRED}) p join last using (event_id, round_id))
 select distinct event_id, player_id from s where player_id is not null and event_id not in (select p_partkey from part where p_partkey % 5 = 0)""")
def pairing_registrations(spark, sf):
    matches = doc.flatten_matches(b.match_documents(spark, sf))
    rounds = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 400).alias("round_id")).distinct().select(
        "round_id", F.lit(0).alias("phase_pos"), F.col("round_id").alias("round_pos"))
    known = table(spark, sf, "part").filter(F.col("p_partkey") % 5 == 0).select(
        F.col("p_partkey").alias("event_id"))
    return doc.registrations_from_pairings(matches, rounds, known)


@query("parse_history", """select event_id, case when event_id % 31 = 0 then null else 'g' || event_id end as game_id, case k % 5 when 0 then epoch(ts)::bigint when 1 then epoch(ts)::bigint when 2 then epoch(ts)::bigint end as started,
 case k % 4 when 0 then true when 1 then false end as ranked, case k % 7 when 0 then 1 when 2 then 2 end::int as match_game_number, case k % 6 when 0 then 'ruby,steel' when 1 then 'amber' end as colours,
 array_to_string(list_filter([case when event_id % 31 = 0 then 'game_id' end, case when k % 7 in (1, 4) then 'match_game_number' end, case when k % 4 = 3 then 'ranked' end, case when k % 5 = 3 then 'started_at' end, case when k % 6 in (3, 4) then 'your_deck_colors' end], lambda x: x is not null), ',') as errors
 from (select * replace (date_trunc('second', ts) as ts) from v_ev)""")
def parse_history_query(spark, sf):
    h = parse_history(b.history_documents(spark, sf))
    return h.select("event_id", "game_id", F.unix_seconds("started_at").alias("started"), "ranked",
                    "match_game_number", F.array_join("your_deck_colors", ",").alias("colours"),
                    F.array_join("errors", ",").alias("errors"))


@query("embedded_events", """select page_id, case when page_id % 11 = 0 then 'invalid_chunk' when page_id % 7 = 0 then 'not_found' end as error, case when page_id % 11 <> 0 and page_id % 7 <> 0 then 'line "1"' || chr(10) || '{x} ' || url end as name from pages""")
def embedded_events(spark, sf):
    out = extract_embedded_json(b.hydrated_pages(spark, sf))
    return out.select("page_id", "error", F.get_json_object("json", "$.name").alias("name"))


@F.pandas_udf(BinaryType())
def packed(text: pd.Series, how: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress(x.encode()) if h == 0 else x.encode() if h == 1 else x.encode()[:40]
                      for x, h in zip(text, how)])


def files(spark, sf):
    o = F.col("game_id")
    how = F.when(o % 13 == 0, 2).when(o % 2 == 0, 0).otherwise(1)
    return b.archives(spark, sf).select(
        F.when(o % 11 == 0, o + 1).otherwise(o).alias("game_id"), packed("body", how).alias("content"))


@query("decode_archives", """select case when o_orderkey % 11 = 0 then o_orderkey + 1 else o_orderkey end as game_id, case when o_orderkey % 13 <> 0 and o_orderkey % 2 = 0 then 'gzip' else 'identity' end as encoding,
 case when o_orderkey % 13 = 0 or o_orderkey % 11 = 0 then 'invalid' else 'valid' end as status, case when o_orderkey % 13 = 0 then 'JSONDecodeError' when o_orderkey % 11 = 0 then 'wrong_game' end as error from orders""")
def decode_archives(spark, sf):
    return a.decode_archives(files(spark, sf)).select("game_id", "encoding", "status", "error")


ACT = """with f as (select o_orderkey as o, i, (o_orderkey + i) % 6 as k from orders, range(9) r(i) where i <= o_orderkey % 4 + 5 and o_orderkey % 17 <> 0),
 s as (select *, case when i < 2 then null else k end as kk from f),
 w as (select *, coalesce(sum((kk in (0, 2))::int) over b, 0) as dropped, coalesce(sum((kk = 2)::int) over b, 0) as inks, coalesce(sum((kk = 2 and i % 2 = 1)::int) over b, 0) as ready,
  coalesce(last_value(case when kk = 4 then i end ignore nulls) over b, 1) as turn, coalesce(last_value(case when kk = 4 then i % 2 + 1 end ignore nulls) over b, 1) as cur, coalesce(last_value(case when kk = 1 then i * 2 end ignore nulls) over b, 0) as lore, lead(kk) over (partition by o order by i) as nk from s window b as (partition by o order by i rows between unbounded preceding and 1 preceding))"""
TYPE = "case when i = 0 then 'choose_starting_player' when i = 1 then 'mulligan' else (['play','quest','ink','challenge','end_turn','undo'])[kk + 1] end"
CARD_ID = "case when kk = 0 and o % 2 = 0 then '2-1' when kk = 0 then '5-' || i when kk = 3 then '3-1' end"


HANDS = ("hand", "hand_after")


def actions(spark, sf, cards=None):
    return a.normalize_actions(a.replay_states(b.archives(spark, sf), cards))


@query("replay_actions", f"""{ACT} select o as game_id, i as seq, {TYPE} as type, case when i > 1 and i % 3 = 0 then 2 else 1 end::int as actor, case when i > 1 and i % 3 = 0 then case when o % 2 = 0 then 'Bob' else 'Player 2' end else 'Ann' end as actor_name,
 case when i > 0 and kk is distinct from 5 then cur end::int as active_player, case when i > 0 then turn end::int as gameplay_turn, {CARD_ID} as card_id, case when kk = 0 and o % 2 = 0 then 'Named' when kk = 0 then 'Seen' when kk = 3 then 'Att' end as card_name,
 case when kk = 0 and o % 2 <> 0 then case when o % 5 = 0 then 'sing' else 'play' end end as play_method, case when kk = 3 then case when o % 2 = 0 and o % 3 = 0 then 'mutual_banish' when o % 2 = 0 then 'defender_banished' when o % 3 = 0 then 'attacker_banished' else 'neither_banished' end end as challenge_outcome,
 case when kk = 3 then i end::int as damage_dealt, nk is not distinct from 5 as undone, case when nk = 5 then i + 1 end::bigint as undone_by_seq, case when i = 0 then o % 2 + 1 end::int as first_player from w""")
def replay_actions(spark, sf):
    return actions(spark, sf, ()).select(
        "game_id", "seq", "type", "actor", "actor_name", "active_player", "gameplay_turn", "card_id",
        "card_name", "play_method", "challenge_outcome", "damage_dealt", "undone", "undone_by_seq",
        "first_player")


@query("replay_states", f"""{ACT} select o as game_id, i as seq, case when i > 1 and i % 3 = 0 then null else 7 - dropped end::int as hand_count, case when i > 1 and i % 3 = 0 then null else lore end::int as lore,
 case when i > 1 and i % 3 = 0 then null else inks end::int as ink_count, case when i > 1 and i % 3 = 0 then null else ready end::int as ready_ink from w""")
def replay_states(spark, sf):
    return actions(spark, sf, ()).select("game_id", "seq", "hand_count", "lore", "ink_count", "ready_ink")


@query("replay_mulligans", """select o_orderkey as game_id, case when o_orderkey % 3 = 0 then '1-0' else '' end as sent, case when o_orderkey % 3 = 0 then '1-99' else '' end as drawn, case when o_orderkey % 3 = 0 then 6 else 7 end::int as kept, case when o_orderkey % 3 = 0 then 1 else 0 end::int as mulligan from orders where o_orderkey % 17 <> 0""")
def replay_mulligans(spark, sf):
    m = actions(spark, sf, HANDS).filter(F.col("mulligan_hand").isNotNull())
    count = t.validated_mulligan(F.col("mulligan_hand.id"), F.col("mulligan_kept.id"), F.col("mulligan_sent.id"),
                                 F.col("mulligan_drawn.id"), F.size("mulligan_sent"), F.size("warnings"), F.lit(2))
    return m.select("game_id", F.array_join("mulligan_sent.id", ",").alias("sent"),
                    F.array_join("mulligan_drawn.id", ",").alias("drawn"),
                    F.size("mulligan_kept").alias("kept"), count.cast("int").alias("mulligan"))


OWN_FRAME = "not (i > 1 and i % 3 = 0)"


@query("replay_features", f"""{ACT}, g as (select o, count(*) filter (kk = 5) as undo_ranges, count(*) filter (nk is distinct from 5 and {OWN_FRAME})::int as own_action_rows,
 count(distinct turn) filter (nk is distinct from 5 and i > 0 and {OWN_FRAME})::int as own_turns, min(i) filter (nk is distinct from 5 and i > 0 and {OWN_FRAME})::bigint as start_seq from w group by 1)
 select o as game_id, {TYPE} as type, count(*) as actions, count(*) filter ({OWN_FRAME}) as own_actions, o % 2 = 0 as went_first, null::boolean as won, undo_ranges::int as undo_ranges, own_action_rows, own_turns, start_seq, 7 as start_hand,
  case when o % 3 = 0 then 1 else 0 end as mulligan, case when o % 3 = 0 then 6 else 7 end as kept, 0 as warnings, 'features_v1' as extractor_version from w join g using (o) where nk is distinct from 5 group by o, 2, undo_ranges, own_action_rows, own_turns, start_seq""")
def replay_features(spark, sf):
    """All features of every game, a row for each type of action."""
    folded = materialize(a.replay_states(b.archives(spark, sf), HANDS), "states")  # read for actions and games
    games = a.normalize_games(folded).dropDuplicates(["game_id"])
    rows = ft.extract_features(a.normalize_actions(folded), games)
    first = F.get("own_turns", F.lit(0))["start"]
    return rows.select("*", F.explode("action_counts").alias("type", "actions")).select(
        "game_id", "type", "actions", F.coalesce(F.try_element_at("own_action_counts", "type"), F.lit(0)).alias("own_actions"),
        "went_first", "won", F.size("undo_ranges").alias("undo_ranges"), F.size("own_actions").alias("own_action_rows"),
        F.size("own_turns").alias("own_turns"), first["seq"].alias("start_seq"), F.size(first["hand"]).alias("start_hand"),
        F.col("mulligan.count").alias("mulligan"), F.size("mulligan.kept").alias("kept"),
        F.col("warning_count").alias("warnings"), "extractor_version")


@query("replay_turn_starts", f"""{ACT} select o as game_id, turn::int as gameplay_turn, min(i) as seq, arg_min(7 - dropped, i)::int as hand_count, arg_min(inks, i)::int as ink_count, count(*) as own_actions from w where nk is distinct from 5 and i > 0 and not (i > 1 and i % 3 = 0) group by 1, 2""")
def replay_turn_starts(spark, sf):
    own = actions(spark, sf, ()).filter(~F.col("undone") & F.col("actor_is_perspective")
                                    & F.col("gameplay_turn").isNotNull())
    return own.groupBy("game_id", "gameplay_turn").agg(
        F.min("seq").alias("seq"), F.min_by("hand_count", "seq").alias("hand_count"),
        F.min_by("ink_count", "seq").alias("ink_count"), F.count(F.lit(1)).alias("own_actions"))


TARGETS = ["2-1", "card 2", "1-99"]


@query("replay_opening_hands", """select o_orderkey as game_id, case when o_orderkey % 3 = 0 then 1 else 0 end::int as mulligan_count, case when o_orderkey % 3 <> 0 then 3 when o_orderkey % 2 = 0 then 3 end::int as post_uninkables, true as initial_target, true as kept_target, true as post_target from orders where o_orderkey % 17 <> 0 and o_orderkey % 2 = 0""")
def replay_opening_hands(spark, sf):
    return t.opening_hands(actions(spark, sf, HANDS), TARGETS)


@query("replay_openings", f"""{ACT}, e as (select *, lead(kk) over (partition by o order by i) as nxt from w), k as (select * from w where nk is distinct from 5 and i > 0),
 g as (select *, first_value(cur) over (partition by o order by i) as fp, sum(case when cur = 1 and (lag_cur is distinct from cur or lag_turn is distinct from turn) then 1 else 0 end) over (partition by o order by i) as own from
  (select *, lag(cur) over (partition by o order by i) as lag_cur, lag(turn) over (partition by o order by i) as lag_turn from k where not (kk is not distinct from 5 and i % 3 = 0)))
 select o as game_id, own::bigint as own_turn, bool_or(kk = 4) is true as complete, max(case when kk = 4 then i end) as end_seq, arg_max(inks, i) filter (kk = 4)::int as ink, arg_max(ready, i) filter (kk = 4)::int as ready_ink,
  case when bool_or(kk = 0 and o % 2 = 0) then true when bool_or(kk = 4) then false end as target_played from g where o % 2 = 0 and cur = 1 and own <= 3 and not (i > 1 and i % 3 = 0) and kk is distinct from 5 group by 1, 2""")
def replay_openings(spark, sf):
    rows = t.replay_own_turns(actions(spark, sf, HANDS), 4096)
    return t.opening_metrics(rows, TARGETS).select(
        "game_id", "own_turn", "complete", "end_seq", "ink", "ready_ink", "target_played")


@query("compact_actions", f"""{ACT} select o as game_id, i as seq, '{{"seq":' || i || ',"type":"' || {TYPE} || '"' || case when i > 0 then ',"gameplay_turn":' || turn else '' end || coalesce(',"card_id":"' || {CARD_ID} || '"', '') || '}}' as action from w""")
def compact_actions(spark, sf):
    rows = actions(spark, sf, ())
    return rows.select("game_id", "seq", a.project_fields({
        c: F.col(c) for c in ("seq", "type", "gameplay_turn", "card_id")}).alias("action"))


@query("replay_rejects", "select o_orderkey as game_id, 'unsupported_format' as state_error from orders where o_orderkey % 17 = 0")
def replay_rejects(spark, sf):
    return a.replay_states(b.archives(spark, sf), ()).filter(F.col("state_error").isNotNull()).select(
        "game_id", "state_error")


LEGACY_RULES = [
    cf.Rule("order_id", "o_orderkey", nullable=False), cf.Rule("seen_at", "seen", "timestamp"),
    cf.Rule("window_start", "day", "boundary", nullable=False), cf.Rule("ranked", "flag", "flag", nullable=False),
    cf.Rule("state", "word", "map", nullable=False, mapping=cf.SYNC_STATE),
    cf.Rule("legacy_id", "o_orderkey", "uuid", namespace="6ba7b8119dad11d180b400c04fd430c8", prefix="order")]


def legacy(spark, sf):
    o = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    words = F.array(*[F.lit(w) for w in (*cf.SYNC_STATE, "LOST")])
    return table(spark, sf, "orders").select(
        o, F.when(o % 7 == 0, F.concat(day, F.lit("T08:00:00"))).when(o % 7 == 1, None).otherwise(
            F.concat(day, F.lit("T08:00:00+01:00"))).alias("seen"),
        F.when(o % 3 == 0, F.concat(day, F.lit("T00:00:00Z"))).otherwise(day).alias("day"),
        F.when(o % 29 == 0, 2).otherwise(o % 2).alias("flag"), F.get(words, (o % 13).cast("int")).alias("word"))


LEGACY = """select *, array_to_string(list_filter([case when o % 7 = 0 then 'seen_at' end, case when o % 29 = 0 then 'ranked' end, case when o % 13 > 4 then 'state' end], lambda x: x is not null), ',') as errors
 from (select o_orderkey as o, o_orderdate as d from orders)"""


@query("conform_table", f"""select o as order_id, case when o % 7 <> 1 then epoch(d + interval 7 hour)::bigint end as seen, epoch(d)::bigint as window_start, o % 2 = 1 as ranked, (['pending','complete','failed','no_results','partial'])[o % 13 + 1] as state, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] as legacy_id
 from (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('order:' || o)::blob) as h from ({LEGACY})) where errors = ''""")
def conform_table(spark, sf):
    clean, _ = cf.conform_table(legacy(spark, sf), LEGACY_RULES)
    return clean.select("order_id", F.unix_seconds("seen_at").alias("seen"),
                        F.unix_seconds("window_start").alias("window_start"), "ranked", "state", "legacy_id")


@query("conform_errors", f"select o as o_orderkey, errors from ({LEGACY}) where errors <> ''")
def conform_errors(spark, sf):
    _, bad = cf.conform_table(legacy(spark, sf), LEGACY_RULES)
    return bad.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("source_preflight", f"select count(*) filter (errors = '') as clean_rows, count(*) filter (errors <> '') as rejected_rows from ({LEGACY})")
def source_preflight(spark, sf):
    return cf.preflight(legacy(spark, sf), {"o_orderkey": "bigint", "seen": "string", "word": "string"}, LEGACY_RULES)


@query("load_and_reconcile", f"select 'load' as table_name, count(*) filter (errors = '') as source_rows, count(*) filter (errors = '') as target_rows, true as digest_match, count(*) filter (errors <> '') as rejected_rows, count(*) filter (errors <> '') = 0 as valid from ({LEGACY})")
def load_and_reconcile(spark, sf):
    return cf.load_and_reconcile(legacy(spark, sf), LEGACY_RULES, scratch_path(spark, "load"),
                                 ["order_id", "state", "legacy_id", "ranked"])


CUSTOMER_RULES = [
    cf.Rule("customer_id", "c_custkey", nullable=False), cf.Rule("nation_id", "c_nationkey", nullable=False),
    cf.Rule("name", "c_name"), cf.Rule("balance", "c_acctbal")]
NATION_RULES = [cf.Rule("nation_id", "n_nationkey", nullable=False), cf.Rule("name", "n_name")]
ORDER_RULES = [
    cf.Rule("order_id", "o_orderkey", nullable=False), cf.Rule("customer_id", "o_custkey", nullable=False),
    cf.Rule("window_start", "day", "boundary", nullable=False), cf.Rule("ranked", "flag", "flag", nullable=False)]


@query("load_table_set", """with o as (select n as load_number, o_orderkey as k, case when n = 2 and o_orderkey % 11 = 0 then -o_custkey else o_custkey end as c, n = 2 and o_orderkey % 29 = 0 as bad from orders, (values (1), (2)) v(n)),
 c as (select 1 as load_number, c_custkey as k, c_nationkey as p from customer union all select 2, c_custkey, c_nationkey from customer union all select 2, c_custkey, c_nationkey from customer where c_custkey % 7 = 0),
 r as (select load_number, 'orders' as table_name, count(*) filter (not bad) as rows, count(*) filter (bad) as rejected_rows, 0 as duplicate_keys, count(*) filter (not bad and c not in (select c_custkey from customer)) as orphans from o group by 1
  union all select load_number, 'customer', count(*), 0, count(*) - count(distinct k), count(*) filter (p not in (select n_nationkey from nation)) from c group by 1
  union all select n, 'nation', (select count(*) from nation), 0, 0, 0 from (values (1), (2)) v(n)),
 s as (select 'orders' as table_name, count(*) as visible_rows, sum(o_custkey)::bigint as visible_sum from orders union all select 'customer', count(*), sum(c_custkey)::bigint from customer union all select 'nation', count(*), sum(n_nationkey)::bigint from nation)
 select load_number, table_name, rows as source_rows, rows as target_rows, true as digest_match, rejected_rows, duplicate_keys::bigint as duplicate_keys, orphans::bigint as orphans, rejected_rows + duplicate_keys + orphans = 0 as valid, visible_rows, visible_sum from r join s using (table_name)""")
def load_table_set(spark, sf):
    """A valid load of three tables, then one with rejected rows, repeated keys and orphans: the first stays visible."""
    orders, customer, nation = (table(spark, sf, n) for n in ("orders", "customer", "nation"))
    o = F.col("o_orderkey")
    text = orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("flag", (o % 2).cast("int"))
    broken = text.withColumn("o_custkey", F.when(o % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))).withColumn(
        "flag", F.when(o % 29 == 0, 2).otherwise(F.col("flag")))
    repeated = customer.unionByName(customer.filter(F.col("c_custkey") % 7 == 0))
    tables, reports = loads.TableSet(spark, scratch_path(spark, "table-set")), []
    relations = [loads.Relation("orders", "customer_id", "customer", "customer_id"),
                 loads.Relation("customer", "nation_id", "nation", "nation_id")]
    for number, (some_orders, some_customers) in enumerate(((text, customer), (broken, repeated)), 1):
        reports.append(tables.load([
            loads.Table("orders", some_orders, ORDER_RULES, ["order_id"]),
            loads.Table("customer", some_customers, CUSTOMER_RULES, ["customer_id"]),
            loads.Table("nation", nation, NATION_RULES, ["nation_id"])], relations).withColumn("load_number", F.lit(number)))
    seen = [tables.read(name).agg(F.count(F.lit(1)).alias("visible_rows"), F.sum(key).cast("long").alias("visible_sum")).select(
        F.lit(name).alias("table_name"), "*") for name, key in (("orders", "customer_id"), ("customer", "customer_id"), ("nation", "nation_id"))]
    return reports[0].unionByName(reports[1]).join(seen[0].unionByName(seen[1]).unionByName(seen[2]), "table_name")


@query("normalize_catalog", """select p_partkey, case when p_partkey % 19 = 0 then null else 'B' || substr(p_brand, 7) || '-' || p_partkey end as card_id, p_name || case when p_partkey % 3 = 0 then ' - Gold' else '' end as name, case when p_partkey % 4 = 0 then 'ruby,steel' when p_partkey % 4 = 1 then 'amber' else '' end as colours,
 (p_size % 10)::int as cost, case when p_partkey % 2 = 0 then 'Action/Song' else 'Character' end as card_type, case when p_partkey % 19 = 0 then 'collector_number' else '' end as errors from part where p_partkey % 10 <> 1""")
def normalize_catalog(spark, sf):
    p = F.col("p_partkey")
    body = F.to_json(F.struct(
        F.concat(F.lit(" "), "p_name").alias("name"), F.when(p % 3 == 0, "Gold ").alias("version"),
        F.when(p % 10 == 1, "FR").when(p % 10 == 2, "EN").alias("lang"),
        F.when(p % 19 == 0, " ").otherwise(p.cast("string")).alias("collector_number"),
        F.struct(F.concat(F.lit("B"), F.expr("substring(p_brand, 7)")).alias("code")).alias("set"),
        F.when(p % 4 == 0, F.array(F.lit("Ruby"), F.lit(" Steel "))).alias("inks"),
        F.when(p % 4 == 1, "Amber").alias("ink"), (F.col("p_size") % 10).alias("cost"),
        F.when(p % 2 == 0, F.array(F.lit("Action"), F.lit("Song"))).otherwise(F.array(F.lit("Character"))).alias("type")))
    docs = table(spark, sf, "part").select(p, body.alias("body"))
    return cat.normalize_catalog(docs).select(
        "p_partkey", "card_id", "name", F.array_join("ink_colors", ",").alias("colours"), "cost",
        "card_type", F.array_join("errors", ",").alias("errors"))


@query("flatten_teams", """select c_custkey, i::int as pos, 'nation_' || c_nationkey as slug, case when i = 0 then c_name when i = 1 then 'second' end as display_name, case when i < 2 and c_custkey % 17 = 0 then -1 when i = 1 and c_custkey % 3 = 0 then c_custkey else c_custkey + i end as player_id,
 case when i = 0 and c_custkey % 2 = 0 then 'captain' else 'member' end as role, case when i < 2 and c_custkey % 17 = 0 then 'player_id' when i = 2 then 'display_name' when i = 1 and c_custkey % 3 = 0 then 'duplicate_id' end as error from customer, range(3) r(i) where c_custkey > 0""")
def flatten_teams(spark, sf):
    c = F.col("c_custkey")
    bad = lambda value: F.when(c % 17 == 0, -1).otherwise(value)
    member = lambda name, value, role: F.struct(
        name.alias("preferred_display_name"), value.alias("provider_id"), role.alias("role"))
    none = F.lit(None).cast("string")
    body = F.to_json(F.struct(
        F.struct(F.concat(F.lit(" NATION_"), F.col("c_nationkey").cast("string")).alias("slug"),
                 F.lit("N").alias("name")).alias("team"),
        F.array(member(F.concat(F.lit(" "), "c_name"), bad(c), F.when(c % 2 == 0, "captain")),
                member(F.lit("second"), bad(F.when(c % 3 == 0, c).otherwise(c + 1)), none),
                member(F.lit(" "), c + 2, none)).alias("members")))
    docs = table(spark, sf, "customer").filter(c > 0).select(c, body.alias("body"))
    return cat.flatten_teams(docs, "provider_id").select(
        "c_custkey", "pos", "slug", "display_name", "player_id", "role", "error")


@query("apply_roster", """select d.c_nationkey::bigint as team_id, d.c_custkey as member_id, d.c_custkey + d.c_custkey % 2 as player_id, case when l.member_id is not null and l.member_id <> d.c_custkey then 'link_conflict' when l.member_id is not null then 'linked'
  when d.c_custkey in (select member_id from v_links) then 'add_link' else 'add_primary_link' end as link_action, case when l.member_id is not null and l.member_id <> d.c_custkey then 'none' when d.c_custkey % 11 <> 0 then 'keep' else 'open' end as membership_action
 from customer d left join v_links l on l.player_id = d.c_custkey + d.c_custkey % 2""")
def apply_roster(spark, sf):
    c = F.col("c_custkey")
    wanted = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("team_id"), c.alias("member_id"), (c + c % 2).alias("player_id"))
    return cat.apply_roster(wanted, b.player_links(spark, sf), b.memberships(spark, sf))


