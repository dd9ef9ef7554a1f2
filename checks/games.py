"""Roster, matchup, weekly, summary and practice queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import query
from checks.ratings import published, r6
from checks.views import color_pair as pair_sql
from checks.views import outcome as outcome_sql
from checks.views import queue_label as queue_sql
from matchloom.functions.labels import color_pair, colors_label, normalize_outcome
from matchloom.operators.keyed import latest_per_key, top_n_with_other
from matchloom.plans import bindings as b
from matchloom.plans import games as g

START, END = dt.datetime(2024, 1, 7, 14), dt.datetime(2024, 1, 14, 14)
W = "started_at >= timestamp '2024-01-07 14:00:00' and started_at < timestamp '2024-01-14 14:00:00'"
NOW = dt.datetime(2024, 1, 28)


def roster(spark, sf):
    return g.roster(b.members(spark, sf), b.memberships(spark, sf), b.teams(spark, sf))


def shown(spark, sf):
    return g.configured(roster(spark, sf), b.accounts(spark, sf))


def results(spark, sf, since=None, until=None):
    return g.game_results(b.observations(spark, sf), b.games(spark, sf), roster(spark, sf),
                          since, until)


@query("roster", "select slug, member_id, preferred_display_name, role from v_roster")
def roster_query(spark, sf):
    return roster(spark, sf).drop("team_name")


@query("configured_members", "select slug, member_id, preferred_display_name from v_configured")
def configured_members(spark, sf):
    return shown(spark, sf).select("slug", "member_id", "preferred_display_name")


@query("latest_observation", "select member_id, game_id, account_id, event_id, result from v_latest_obs")
def latest_observation(spark, sf):
    return g.latest_observations(b.observations(spark, sf)).select(
        "member_id", "game_id", "account_id", "event_id", "result")


@query("observer_counts", "select member_id, game_id, team_observers from v_results")
def observer_counts(spark, sf):
    return results(spark, sf).select("member_id", "game_id", "team_observers")


@query("matchup_counts", """select member_id, result, array_to_string(your_deck_colors, '/') as ours_raw, array_to_string(opponent_deck_colors, '/') as theirs_raw,
 queue_id, queue_name, mode, match_format, ranked, team_observers, count(*) as games from v_results group by all""")
def matchup_counts(spark, sf):
    out = g.matchup_counts(results(spark, sf))
    return out.withColumn("ours_raw", F.array_join("your_deck_colors", "/")).withColumn(
        "theirs_raw", F.array_join("opponent_deck_colors", "/")).drop(*g.DECK_COLUMNS)


PIVOT = ", ".join(f"count(*) filter (outcome = '{o}') as {o}" for o in ("win", "loss", "draw", "unknown"))
MATCH = f"""select r.member_id, c.preferred_display_name, {pair_sql('your_deck_colors')} as ours, {pair_sql('opponent_deck_colors')} as theirs, {outcome_sql('result')} as outcome,
 {queue_sql('r')} as queue, queue_id, queue_name, mode, match_format, ranked, team_observers from v_results r join v_configured c using (member_id)"""


@query("matchup_report", f"""select member_id, preferred_display_name, ours, theirs, queue, {PIVOT}, count(*) as games from ({MATCH}) where team_observers = 1
 group by member_id, preferred_display_name, ours, theirs, queue, queue_id, queue_name, mode, match_format, ranked""")
def matchup_report(spark, sf):
    return g.matchup_report(g.matchup_counts(results(spark, sf)), shown(spark, sf))


@query("matchup_report_team", f"""select ours, theirs, queue, {PIVOT}, count(*) as games from ({MATCH}) where team_observers = 1 and theirs = 'Ruby/Sapphire'
 group by ours, theirs, queue, queue_id, queue_name, mode, match_format, ranked""")
def matchup_report_team(spark, sf):
    return g.matchup_report(g.matchup_counts(results(spark, sf)), shown(spark, sf), team=True,
                            opponent="Ruby/Sapphire")


@query("internal_games", f"select count(*) as internal_games from ({MATCH}) where team_observers > 1")
def internal_games(spark, sf):
    return g.internal_games(g.matchup_counts(results(spark, sf)), shown(spark, sf))


@query("sync_coverage", """select slug, member_id, preferred_display_name, last_sync, coalesce(n, 0) as accounts, coalesce(bad, 0) as needs_attention, last_sync is not null as synced
 from v_roster left join (select member_id, max(last_sync_completed_at) as last_sync, count(*) n, count(*) filter (status <> 'active') bad from v_accounts group by 1) using (member_id)""")
def sync_coverage(spark, sf):
    return g.coverage(roster(spark, sf), b.accounts(spark, sf))


@query("weekly_by_member", f"""select member_id, preferred_display_name, colors, coalesce(win, 0) as win, coalesce(loss, 0) as loss, coalesce(draw, 0) as draw, coalesce(unknown, 0) as unknown, coalesce(games, 0) as games
 from v_configured left join (select member_id, colors, {PIVOT}, count(*) as games from (select member_id, {pair_sql('your_deck_colors')} as colors, {outcome_sql('result')} as outcome from v_results where {W}) group by 1, 2) using (member_id)""")
def weekly_by_member(spark, sf):
    return g.weekly_by_member(g.matchup_counts(results(spark, sf, START, END)), shown(spark, sf))


RECORDS = f"""select colors, {PIVOT}, count(*) as games, case when count(*) filter (outcome in ('win','loss')) > 0 then 100.0::double * count(*) filter (outcome = 'win') / count(*) filter (outcome in ('win','loss')) end as win_percentage
 from (select {pair_sql('opponent_deck_colors')} as colors, {outcome_sql('result')} as outcome from v_results where {W} and member_id in (select member_id from v_configured)) group by 1"""


def records(spark, sf):
    return g.opponent_records(g.matchup_counts(results(spark, sf, START, END)), shown(spark, sf))


@query("opponent_records", f"select * replace (round(win_percentage, 6) as win_percentage) from ({RECORDS})")
def opponent_records(spark, sf):
    return records(spark, sf).withColumn("win_percentage", F.round("win_percentage", 6))


@query("opponent_extremes", f"""with r as ({RECORDS}), k as (select * from r where colors <> 'Unknown')
 select kind, colors, win, loss, draw, unknown, games, round(win_percentage, 6) as win_percentage from (
 select 'most_losses' as kind, * from k where loss > 0 and loss = (select max(loss) from k)
 union all select 'worst_percentage', * from k where win_percentage = (select min(win_percentage) from k)
 union all (select 'popular', * from k order by games desc, colors limit 3)
 union all select 'unknown', * from r where colors = 'Unknown')""")
def opponent_extremes(spark, sf):
    return g.opponent_extremes(records(spark, sf)).withColumn(
        "win_percentage", F.round("win_percentage", 6))


EVIDENCE = """select member_id, game_id, normalization_id, case when projection_version = 1 then mulligan_count end as mulligan_count, projection_version is distinct from 1 as projection_pending
 from (select o.member_id, r.*, row_number() over (partition by o.member_id, o.game_id order by r.fetched_at desc, r.created_at desc, r.normalization_id) as n
 from v_latest_obs o join v_replays r on r.account_id = o.account_id and r.game_id = o.game_id where r.status = 'valid' and r.normalization_status = 'valid' and r.parser_version = 'parser_v1') where n = 1"""


def evidence(spark, sf):
    return g.latest_evidence(g.latest_observations(b.observations(spark, sf)), b.replays(spark, sf),
                             "parser_v1", 1)


@query("latest_evidence", EVIDENCE)
def latest_evidence(spark, sf):
    return evidence(spark, sf)


@query("member_summary", f"""with e as ({EVIDENCE}), r as (select v.*, {pair_sql('your_deck_colors')} as colors, e.mulligan_count, e.projection_pending from v_results v left join e using (member_id, game_id)),
 t as (select member_id, count(*) games, avg(mulligan_count) a, count(mulligan_count) s, count(*) filter (projection_pending) p, count(*) filter (colors <> 'Unknown') k from r group by 1),
 c as (select member_id, colors, count(*) n from r where colors <> 'Unknown' group by 1, 2),
 top as (select member_id, max(n) as top_count, string_agg(colors, ', ' order by colors) as top_colors from (select *, rank() over (partition by member_id order by n desc) as q from c) where q = 1 group by 1)
 select slug, member_id, preferred_display_name, coalesce(games, 0) as games, round(a, 6) as mulligan_average, coalesce(s, 0) as sample, coalesce(p, 0) as pending, coalesce(k, 0) as known_colors,
 coalesce(top_count, 0) as top_count, top_colors from v_configured left join t using (member_id) left join top using (member_id)""")
def member_summary(spark, sf):
    out = g.member_summary(results(spark, sf), evidence(spark, sf), shown(spark, sf))
    return out.withColumn("mulligan_average", F.round("mulligan_average", 6))


def practice(spark, sf, ranked=None, limit=None):
    return g.practice_history(results(spark, sf), evidence(spark, sf), NOW, 20, ranked, limit)


P = f"""select r.*, {outcome_sql('result')} as outcome, row_number() over (partition by member_id order by started_at desc, game_id) as game_rank
 from v_results r where started_at >= timestamp '2024-01-08' and started_at <= timestamp '2024-01-28'"""
LABEL = "case when your_deck_colors is null or len(your_deck_colors) = 0 then 'Unknown' else array_to_string(list_sort(list_distinct(list_transform(your_deck_colors, lambda x: upper(x[1]) || lower(x[2:])))), '/') end"


@query("practice_history", f"""select p.member_id, p.game_id, p.outcome, p.game_rank::int as game_rank, {LABEL} as deck_label, e.normalization_id, e.mulligan_count,
 count(*) over (partition by p.member_id) > 20 as truncated from ({P}) p left join ({EVIDENCE}) e using (member_id, game_id) qualify game_rank <= 20""")
def practice_history(spark, sf):
    return practice(spark, sf, limit=20).select(
        "member_id", "game_id", "outcome", "game_rank", "deck_label", "normalization_id",
        "mulligan_count", "truncated")


@query("wld_record", f"""select member_id, count(*) filter (outcome = 'win') as wins, count(*) filter (outcome = 'loss') as losses, count(*) filter (outcome = 'draw') as draws, count(*) filter (outcome = 'unknown') as unknown,
 count(*) as games, round(100.0::double * count(*) filter (outcome = 'win') / nullif(count(*) filter (outcome <> 'unknown'), 0), 6) as win_percentage from ({P} and ranked) group by 1""")
def wld_record(spark, sf):
    out = g.practice_record(practice(spark, sf, ranked=True), ["member_id"])
    return out.withColumn("win_percentage", F.round("win_percentage", 6))


@query("breakdown_top_n", f"""with c as (select member_id, {LABEL} as deck_label, count(*) as games from v_results group by 1, 2), r as (select *, row_number() over (partition by member_id order by games desc, deck_label) as n from c)
 select member_id, deck_label, games, false as is_other from r where n <= 12 union all
 select member_id, 'Other ' || count(*) || ' groups', sum(games)::bigint, true from r where n > 12 group by 1""")
def breakdown_top_n(spark, sf):
    sizes = results(spark, sf).groupBy(
        "member_id", colors_label("your_deck_colors").alias("deck_label")).agg(
        F.count(F.lit(1)).alias("games"))
    return top_n_with_other(sizes, ["member_id"], "deck_label", "games", 12)


@query("team_leaderboard", """select slug, member_id, preferred_display_name, role, player_id, round(rating, 6) as rating, matches_played, case when rating is not null then row_number() over
 (partition by slug order by rating is null, rating desc, matches_played desc, coalesce(player_id, 0), member_id) end as team_rank
 from v_roster left join (select member_id, player_id from v_links where is_primary) using (member_id) left join v_current using (player_id)""")
def team_leaderboard(spark, sf):
    out = g.team_leaderboard(roster(spark, sf), b.player_links(spark, sf), published(spark, sf).current)
    return out.select("slug", "member_id", "preferred_display_name", "role", "player_id",
                      r6("rating"), "matches_played", "team_rank")


@query("recent_team_events", """select distinct slug, event_id, name, start_datetime, player_id, preferred_display_name from v_roster join (select * from v_links where is_primary) using (member_id)
 join (select event_id, player1_id as player_id from v_matches union select event_id, player2_id from v_matches) using (player_id) join v_events using (event_id)
 where start_datetime >= timestamp '1998-01-01' and start_datetime <= timestamp '1998-03-01'""")
def recent_team_events(spark, sf):
    return g.recent_team_events(
        roster(spark, sf), b.player_links(spark, sf), b.matches(spark, sf), b.events(spark, sf),
        dt.datetime(1998, 1, 1), dt.datetime(1998, 3, 1))


@query("event_participants", """select event_id, count(*) as players from (select event_id, player_id from v_registrations union select event_id, player1_id from v_matches where player1_id is not null
 union select event_id, player2_id from v_matches where player2_id is not null) group by 1""")
def event_participants(spark, sf):
    return g.event_participants(b.registrations(spark, sf), b.matches(spark, sf))


USE = """count(*) as uses, count(distinct user_id) as users, count(*) filter (not succeeded) as failures, count(*) filter (invocation_mode = 'prefix') as prefix_uses,
 round_even(avg(duration_ms), 0)::bigint as average_ms, round(100.0::double * count(*) filter (succeeded) / count(*), 6) as success_rate"""


@query("usage_by_command", f"select command_name, {USE} from v_usage where occurred_at >= timestamp '2024-01-03' group by 1")
def usage_by_command(spark, sf):
    from matchloom.functions.times import instant
    recent = b.usage(spark, sf).filter(F.col("occurred_at") >= instant("2024-01-03"))
    return g.usage_summary(recent, ["command_name"]).withColumn(
        "success_rate", F.round("success_rate", 6))


@query("usage_overall", f"select {USE} from v_usage")
def usage_overall(spark, sf):
    return g.usage_summary(b.usage(spark, sf), []).withColumn(
        "success_rate", F.round("success_rate", 6))


@query("status_counts", "select count(*) as total, count(*) filter (participant_count = 2) as two_player, count(*) filter (participant_count > 2) as multi, count(*) filter (participant_count is null) as unknown from v_matches")
def status_counts(spark, sf):
    return g.status_counts(b.matches(spark, sf))


@query("observation_labels", f"select event_id, {pair_sql('your_deck_colors')} as pair, {LABEL} as label, {outcome_sql('result')} as outcome from v_obs")
def observation_labels(spark, sf):
    return b.observations(spark, sf).select(
        "event_id", color_pair("your_deck_colors").alias("pair"),
        colors_label("your_deck_colors").alias("label"), normalize_outcome("result").alias("outcome"))


@query("pending_archives", """select account_id, game_id, event_id from v_obs o where replay_url is not null and not exists
 (select 1 from v_replays r where r.account_id = o.account_id and r.game_id = o.game_id and r.provider_replay_id is not distinct from o.provider_replay_id)""")
def pending_archives(spark, sf):
    o = b.observations(spark, sf).filter(F.col("replay_url").isNotNull())
    r = b.replays(spark, sf).select(
        F.col("account_id").alias("a"), F.col("game_id").alias("gm"),
        F.col("provider_replay_id").alias("p"))
    return o.join(r, (o.account_id == r.a) & (o.game_id == r.gm)
                  & o.provider_replay_id.eqNullSafe(r.p), "left_anti").select(
        "account_id", "game_id", "event_id")


@query("latest_archive_per_game", "select game_id, replay_id, status from (select *, row_number() over (partition by game_id order by fetched_at desc, replay_id desc) n from v_replays) where n = 1")
def latest_archive_per_game(spark, sf):
    return latest_per_key(b.replays(spark, sf), ["game_id"],
                          [F.col("fetched_at").desc(), F.col("replay_id").desc()]).select(
        "game_id", "replay_id", "status")

