"""DuckDB definitions of the domain views in ``matchloom.plans.bindings``."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["v_pairs"] = """
select o_orderkey // 2 as pair_id,
  max(case when o_orderkey % 2 = 0 then o_custkey end) c1, max(case when o_orderkey % 2 = 1 then o_custkey end) c2,
  max(case when o_orderkey % 2 = 0 then o_totalprice end) x1, max(case when o_orderkey % 2 = 1 then o_totalprice end) x2,
  max(case when o_orderkey % 2 = 0 then date_diff('day', date '1995-01-01', o_orderdate::date) end) d1,
  max(case when o_orderkey % 2 = 1 then date_diff('day', date '1995-01-01', o_orderdate::date) end) d2,
  max(case when o_orderkey % 2 = 0 then o_orderstatus end) s1, max(case when o_orderkey % 2 = 1 then o_orderstatus end) s2
from orders group by 1"""
VIEWS["v_matches"] = """
select *, case when is_draw then is_draw and (match_id // 2) % 2 = 0 else false end as is_intentional_draw from (
select pair_id * 2 as match_id, day as event_id, day * 4 + pair_id % 4 as round_id,
  case when pair_id % 61 = 5 then null else one end as player1_id,
  case when bye then null else c2 end as player2_id,
  case when (near and pair_id % 67 <> 0 and pair_id % 71 <> 0) or pair_id % 67 = 0 then null
       when pair_id % 71 = 0 then -1
       when bye or x1 >= x2 then one else c2 end as winner_id,
  (near and pair_id % 67 <> 0 and pair_id % 71 <> 0) as is_draw,
  case when pair_id % 89 = 0 then null when coalesce(s1, s2) = 'P' and pair_id % 5 = 0 then 'PENDING' else 'COMPLETE' end as match_status,
  bye as is_bye, pair_id % 97 = 3 as is_ghost_match,
  case when bye then 1 when pair_id % 53 = 0 then 3 when pair_id % 59 = 0 then null else 2 end as participant_count,
  floor(coalesce(x1, x2) / 100000)::int as player1_score, floor(x2 / 100000)::int as player2_score
from (select *, coalesce(d1, d2)::bigint as day, coalesce(c1, c2) as one,
        (c1 is null or c2 is null or pair_id % 29 = 7) as bye,
        (not (c1 is null or c2 is null or pair_id % 29 = 7) and abs(x1 - x2) < 5000) as near from v_pairs))"""
VIEWS["v_events"] = """
select event_id, 'Event ' || event_id as name,
  case when event_id % 73 = 0 then null else day + interval 18 hour end as start_datetime,
  case when event_id % 31 = 0 then null else day + interval 24 hour end as end_datetime,
  case when event_id % 41 = 0 then null when event_id % 7 < 4 then 'Core Constructed' when event_id % 7 < 6 then 'Infinity Constructed' else 'Draft' end as format,
  (['America/New_York','UTC','Asia/Tokyo','Nowhere/Zone',null])[event_id % 5 + 1] as timezone,
  case when event_id % 3 = 0 then null else (['upcoming','inProgress','COMPLETE',' event_in_progress ','live'])[event_id % 5 + 1] end as display_status,
  (['upcoming','inProgress','COMPLETE',' event_in_progress ','live'])[event_id % 4 + 1] as event_status,
  case when event_id % 6 = 0 then 'finished' else 'running' end as lifecycle_status,
  case when event_id % 37 = 0 then '  ' else 'https://events.example/' || event_id end as source_url,
  event_id % 100 as store_id, day + interval 21 hour as last_synced
from (select distinct date_diff('day', date '1995-01-01', o_orderdate::date)::bigint as event_id, o_orderdate as day from orders)"""
VIEWS["v_sync"] = """
select event_id, case when event_id % 17 = 0 then 'partial' when event_id % 13 = 0 then 'failed' when event_id % 11 = 0 then 'importing' else 'complete' end as state,
  case when event_id % 5 = 0 then null else last_synced - interval 90 minute end as last_attempt_at
from v_events where event_id % 19 <> 0"""
VIEWS["v_rounds"] = """
select event_id * 4 + r as round_id, event_id, r + 1 as round_number, event_id * 2 + r // 2 as phase_id
from v_events, range(4) t(r) where (event_id * 4 + r) % 43 <> 0"""
VIEWS["v_phases"] = """
select event_id * 2 + p as phase_id, event_id, p as phase_order, case when p = 0 then 'Swiss' else 'Top cut' end as phase_name
from v_events, range(2) t(p)"""
VIEWS["v_players"] = """
select c_custkey as player_id, case when c_custkey % 23 = 0 then null else c_name end as display_name,
  lower(c_mktsegment || '_' || c_custkey) as username from customer"""
VIEWS["v_registrations"] = """
select event_id, player_id, event_id * 10000000 + player_id as registration_id,
  case when player_id % 3 = 0 then player_id % 5 end as matches_won,
  case when player_id % 3 = 0 then player_id % 4 end as matches_lost,
  case when player_id % 3 = 0 then 0 end as matches_drawn,
  (player_id * 7 + event_id) % 64 + 1 as placement,
  (['ACTIVE',' complete ','DROPPED'])[(player_id + event_id) % 3 + 1] as registration_status,
  timestamp '1998-02-01' - (player_id % 20) * interval 1 day as registration_synced
from (select event_id, player1_id as player_id from v_matches where player1_id is not null
      union select event_id, player2_id from v_matches where player2_id is not null)"""
VIEWS["v_teams"] = """
select n_nationkey::bigint as team_id, lower(n_name) as slug, n_name as team_name,
  case when n_nationkey % 5 = 4 then 'archived' else 'active' end as status from nation"""
VIEWS["v_members"] = """
select c_custkey as member_id, c_name as preferred_display_name, case when c_acctbal > 0 then 'active' else 'inactive' end as status from customer"""
VIEWS["v_memberships"] = """
select c_nationkey::bigint as team_id, c_custkey as member_id, case when c_custkey % 9 = 0 then 'captain' else 'member' end as role,
  case when c_custkey % 11 = 0 then timestamp '2024-01-01' end as ended_at from customer"""
VIEWS["v_links"] = """
select c_custkey as member_id, c_custkey as player_id, c_custkey % 7 <> 0 as is_primary from customer where c_custkey % 13 <> 0"""
VIEWS["v_ev"] = """select *, json_extract(props, '$.k')::int as k from events"""
VIEWS["v_accounts"] = """
select user_id as account_id, user_id // 2 as member_id,
  case when user_id % 10 < 7 then 'active' when user_id % 10 < 9 then 'auth_error' else 'disabled' end as status,
  case when user_id % 17 = 0 then null when user_id % 13 = 0 then ' env:  ' when user_id % 7 = 0 then 'vault:key' else ' env:KEY_' || user_id end as credential_ref,
  case when user_id % 5 <> 0 then max(ts) end as last_sync_completed_at
from events group by user_id"""
_C = "['amber','amethyst','emerald','ruby','sapphire','steel']"
VIEWS["v_obs"] = f"""
select user_id as account_id, user_id // 2 as member_id, event_id // 4 as game_id,
  (['won','loss',' Tie ','WIN','lost','abandoned',null])[k % 7 + 1] as result,
  case when k % 4 = 3 then null else k % 2 = 0 end as went_first,
  case when k % 17 = 0 then ['grey'] when k % 19 = 0 then null else [({_C})[k % 6 + 1], ({_C})[(k // 6) % 6 + 1]] end as your_deck_colors,
  case when (k + 5) % 17 = 0 then ['grey'] when (k + 5) % 19 = 0 then null else [({_C})[(k + 5) % 6 + 1], ({_C})[(k // 6 + 5) % 6 + 1]] end as opponent_deck_colors,
  ts as last_seen_at, event_id, 'r' || (event_id % 7) as provider_replay_id,
  case when event_id % 9 <> 0 then 'https://replays.example/' || event_id end as replay_url
from v_ev"""
VIEWS["v_games"] = """
select game_id, started_at, (['core-bo1','infinity-bo3','core_infinity',null])[game_id % 4 + 1] as queue_id,
  case when game_id % 3 = 0 then null else 'Core Constructed' end as queue_name,
  case when game_id % 6 = 1 then 'casual' end as mode, (['bo1','bo3',null])[game_id % 3 + 1] as match_format,
  case when game_id % 5 = 0 then null else game_id % 5 < 3 end as ranked
from (select event_id // 4 as game_id, min(ts) as started_at from events group by 1)"""
VIEWS["v_replays"] = """
select user_id as account_id, event_id // 4 as game_id, event_id as replay_id,
  case when event_id % 10 <> 0 then 'r' || (event_id % 7) end as provider_replay_id,
  case when event_id % 11 = 0 then 'invalid' else 'valid' end as status, ts + interval 1 hour as fetched_at,
  event_id * 10 as normalization_id, case when event_id % 13 = 0 then 'invalid' else 'valid' end as normalization_status,
  case when event_id % 17 = 0 then 'parser_v0' else 'parser_v1' end as parser_version, ts + interval 2 hour as created_at,
  case when event_id % 5 = 0 then null else 1 end as projection_version,
  case when event_id % 5 <> 0 and event_id % 7 <> 0 then k % 8 end as mulligan_count
from v_ev where event_id % 3 <> 0"""
VIEWS["v_usage"] = """
select ts as occurred_at, event_type as command_name, (['slash','prefix','button'])[k % 3 + 1] as invocation_mode, user_id,
  value >= 5 as succeeded, (trunc(value * 10))::int as duration_ms from v_ev"""
_T = "['Amber','Amethyst','Emerald','Ruby','Sapphire','Steel']"
VIEWS["v_catalog"] = f"""
select p_partkey::varchar as card_id, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || case when p_partkey % 4 = 0 then '  – Édition ' || (p_partkey // 8) else '' end as name,
  case when p_partkey % 10 = 3 then 'promo' else (p_partkey % 250)::varchar end as collector_number,
  case when p_partkey % 21 = 0 then []::varchar[] else [({_T})[p_size % 6 + 1]] end as ink_colors,
  case when p_partkey % 33 = 0 then null else p_size % 10 end as cost, p_size % 2 = 0 as inkable,
  case when p_type = 'PROMO' then 'Location' when p_type = 'SMALL' then 'Action' else 'Character' end as card_type,
  [p_type] as classifications,
  'Gains 2 until the start of ' || case when p_partkey % 2 = 0 then 'your' else 'their' end || ' next turn' as rules_text,
  case when p_partkey % 12 = 0 then null else p_size % 7 end as strength, 3 as willpower, p_partkey % 4 as lore,
  case when p_partkey % 2 = 0 then 2 end as move_cost, p_brand as set_name
from part"""
VIEWS["v_actions"] = """
select conv_id as game_id, turn as seq, case when role = 'system' then null when role = 'user' then 1 else 2 end as active_player,
  case when role = 'system' then null when (turn % 5 = 3) = (role = 'user') then 2 else 1 end as actor,
  turn // 2 + 1 as turn_label,
  case when n % 9 = 0 then 'undo' else (['play','quest','ink','challenge','end_turn','choice'])[n % 6 + 1] end as type,
  case when n % 3 = 0 then null else (n % 500)::varchar end as card_id, n as size
from (select *, length(text) as n from conversations)"""

VIEWS["v_refs"] = """
select l_orderkey as game_id, case when l_partkey % 8 = 4 then 'x-' || l_partkey else l_partkey::varchar end as card_id,
  case when l_partkey % 5 = 0 then null when l_partkey % 7 = 0 and l_suppkey % 3 = 0 then 'Other name' else upper(name) end as observed_name
from lineitem join v_catalog on card_id = l_partkey::varchar"""
VIEWS["v_aliases"] = """
select 'x-' || card_id as card_id, case when card_id::bigint % 11 = 0 then 'No such card' else name end as expected_name
from v_catalog where card_id::bigint % 8 = 4 and card_id::bigint % 3 <> 0"""
VIEWS["v_undo"] = """
select user_id as game_id, event_id as seq, case when event_type = 'error' then 'undo' else event_type end as type,
  case when event_type = 'error' then event_id - k * 6 end as target_seq, case when k % 4 = 0 then null else k end as card_no from v_ev"""

# Rating candidates and the exact Elo run as a wavefront recursion (FIXED: K 32, start 1500).
VIEWS["v_candidates"] = """
select m.match_id, m.event_id, m.round_id, m.player1_id, m.player2_id, m.winner_id, m.is_draw, m.match_status, m.is_bye,
  m.is_ghost_match, m.participant_count, e.start_datetime as event_start_datetime, e.format as event_format,
  s.state as event_sync_state, coalesce(p.phase_order, 0) as phase_order, coalesce(r.round_number, 0) as round_number
from v_matches m join v_events e using (event_id) left join v_rounds r on r.round_id = m.round_id
left join v_phases p on p.phase_id = r.phase_id left join v_sync s on s.event_id = m.event_id"""
LEGACY = """case when match_status is distinct from 'COMPLETE' then 'match_not_complete' when is_bye then 'bye'
  when is_ghost_match then 'ghost_match' when participant_count is distinct from 2 then 'not_two_player'
  when player1_id is null or player2_id is null then 'missing_player' when player1_id = player2_id then 'same_player'
  when winner_id is null and not is_draw then 'missing_result'
  when winner_id is not null and winner_id not in (player1_id, player2_id) then 'invalid_winner'
  when event_start_datetime is null then 'missing_event_start' {more} else 'included' end"""
GLOBAL = LEGACY.format(more="""when event_format is null or event_format not in ('Core Constructed', 'Infinity Constructed') then 'unsupported_event_format'
  when event_sync_state is distinct from 'complete' then 'event_not_complete'""")
VIEWS["v_inputs"] = f"""
select row_number() over (order by event_start_datetime, event_id, phase_order, round_number, match_id) as sequence, *
from (select *, {GLOBAL} as reason from v_candidates) where reason = 'included'"""
VIEWS["v_turns"] = """
select sequence as seq, player1_id as p1, player2_id as p2, case when is_draw then 0.5::double when winner_id = player1_id then 1.0::double else 0.0::double end as s1 from v_inputs"""
VIEWS["v_index"] = """
select seq, p, row_number() over (partition by p order by seq) as k from (select seq, p1 as p from v_turns union all select seq, p2 from v_turns)"""
VIEWS["v_indexed"] = """
select t.*, a.k as k1, b.k as k2 from v_turns t join v_index a on a.seq = t.seq and a.p = t.p1 join v_index b on b.seq = t.seq and b.p = t.p2"""
VIEWS["v_state"] = """
select 0 as step, p, 1::bigint as nxt, 1500.0::double as r, null::bigint as last_seq from (select distinct p from v_index)
union all
(with ready as (select m.seq, m.p1 a, m.p2 b, x.r ra, y.r rb, m.s1 from v_state x join v_indexed m on m.p1 = x.p and m.k1 = x.nxt
     join v_state y on m.p2 = y.p and m.k2 = y.nxt),
 upd as (select seq, a p, ra + 32.0 * (s1 - 1.0 / (1.0 + pow(10.0::double, (rb - ra) / 400.0))) r from ready union all
     select seq, b, rb + 32.0 * ((1.0 - s1) - 1.0 / (1.0 + pow(10.0::double, (ra - rb) / 400.0))) from ready)
 select s.step + 1, s.p, s.nxt + case when u.p is null then 0 else 1 end, coalesce(u.r, s.r), u.seq
 from v_state s left join upd u on u.p = s.p where exists (select 1 from ready))"""
VIEWS["v_after"] = """select p as player_id, last_seq as sequence, r as rating_after from v_state where last_seq is not null"""
VIEWS["v_history"] = """
select h.*, h.rating_after - h.rating_before as rating_change, o.rating_before as opponent_rating_before from
 (select i.sequence, i.match_id, i.event_id, s.player_id, case when s.player_id = i.player1_id then i.player2_id else i.player1_id end as opponent_id,
   coalesce(lag(s.rating_after) over (partition by s.player_id order by s.sequence), 1500.0::double) as rating_before, s.rating_after,
   case when i.is_draw then 'DRAW' when i.winner_id = s.player_id then 'WIN' else 'LOSS' end as result
  from v_inputs i join v_after s on s.sequence = i.sequence) h
 join (select sequence, player_id, coalesce(lag(rating_after) over (partition by player_id order by sequence), 1500.0::double) as rating_before from v_after) o
   on o.sequence = h.sequence and o.player_id = h.opponent_id"""
VIEWS["v_current"] = """
select player_id, arg_max(rating_after, sequence) as rating, count(*) as matches_played, count(*) filter (result = 'WIN') as wins,
  count(*) filter (result = 'LOSS') as losses, count(*) filter (result = 'DRAW') as draws, greatest(1500.0::double, max(rating_after)) as peak_rating
from v_history group by player_id"""

# Roster, latest observation and observer counts.
VIEWS["v_roster"] = """
select t.slug, m.member_id, m.preferred_display_name, s.role from v_members m join v_memberships s using (member_id) join v_teams t using (team_id)
where t.status = 'active' and m.status = 'active' and s.ended_at is null"""
VIEWS["v_configured"] = """
select * from v_roster where member_id in (select member_id from v_accounts where status in ('active', 'auth_error')
  and trim(credential_ref) like 'env:%' and length(trim(substr(trim(credential_ref), 5))) > 0)"""
VIEWS["v_latest_obs"] = """
select * from (select *, row_number() over (partition by member_id, game_id order by last_seen_at desc, account_id, event_id) as rn from v_obs) where rn = 1"""


def outcome(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    return (f"case when {t} in ('win','won') then 'win' when {t} in ('loss','lost') then 'loss' "
            f"when {t} in ('draw','tie') then 'draw' else 'unknown' end")


def color_pair(c: str) -> str:
    return (f"case when {c} is null or len({c}) = 0 or len(list_filter({c}, lambda x: not list_contains({_C}, lower(trim(x))))) > 0 then 'Unknown' "
            f"else array_to_string(list_filter({_T}, lambda y: list_contains(list_transform({c}, lambda x: lower(trim(x))), lower(y))), '/') end")


def queue_label(a: str) -> str:
    tok = f"regexp_extract_all(lower(coalesce({a}.queue_id,'') || ' ' || coalesce({a}.queue_name,'')), '[a-z]+')"
    return (f"case when list_contains({tok},'infinity') and not list_contains({tok},'core') then 'Infinity' "
            f"when list_contains({tok},'core') and not list_contains({tok},'infinity') then 'Core' else 'Format unknown' end || ' · ' || "
            f"coalesce(nullif({a}.queue_name,''), nullif({a}.queue_id,''), nullif({a}.mode,''), 'Unknown queue') || ' · ' || "
            f"coalesce(nullif({a}.match_format,''), 'match format unknown') || ' · ' || "
            f"case when {a}.ranked then 'ranked' when not {a}.ranked then 'unranked' else 'rank unknown' end")


VIEWS["v_results"] = """
select o.member_id, o.result, o.your_deck_colors, o.opponent_deck_colors, g.queue_id, g.queue_name, g.mode, g.match_format, g.ranked,
  c.n as team_observers, o.game_id, g.started_at
from v_latest_obs o join v_games g using (game_id)
join (select game_id, count(*) n from v_latest_obs where member_id in (select member_id from v_roster) group by 1) c using (game_id)
where o.member_id in (select member_id from v_roster)"""


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in definition order."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo += [d for d in _needs(VIEWS[v]) if d != v]
    if not wanted:
        return sql
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in VIEWS if v in wanted)
    body = sql.strip()
    if body.lower().startswith("with "):
        body = "select * from (" + body + ")"
    return f"with recursive {ctes}\n{body}"
