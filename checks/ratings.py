"""Rating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.views import GLOBAL, LEGACY
from matchloom.operators.digest import ordered_digest
from matchloom.plans import bindings as b
from matchloom.plans import ratings as r
from matchloom.plans.elo import elo_history
from matchloom.plans.policies import reason_counts, with_reason
from matchloom.session import shared_dir

PUBLICATION = "global_elo"


def candidates(spark, sf):
    return r.rating_candidates(b.matches(spark, sf), b.events(spark, sf), b.rounds(spark, sf),
                               b.phases(spark, sf), b.event_sync_state(spark, sf))


def store(spark):
    return r.RunStore(
        spark, f"{shared_dir(spark)}/matchloom/{spark.sparkContext.applicationId}/runs")


def published(spark, sf):
    """The published run of this data set, built on first use."""
    runs, name = store(spark), f"{PUBLICATION}@{sf}"
    run = runs.published(name)
    if run is None:
        runs.build_and_publish_if_changed(name, candidates(spark, sf))
        run = runs.published(name)
    return run


def r6(c, alias=None):
    return F.round(c, 6).alias(alias or c)


@query("candidate_facts", """select match_id, event_id, event_format, event_sync_state, phase_order::int as phase_order, round_number::int as round_number from v_candidates""")
def candidate_facts(spark, sf):
    return candidates(spark, sf).select(
        "match_id", "event_id", "event_format", "event_sync_state", F.col("phase_order").cast("int"),
        F.col("round_number").cast("int"))


@query("eligibility_reasons", f"select reason, count(*) as matches from (select {LEGACY.format(more='')} as reason from v_candidates) group by 1")
def eligibility_reasons(spark, sf):
    return reason_counts(candidates(spark, sf), "legacy")


@query("eligibility_global", f"select match_id, {GLOBAL} as reason from v_candidates")
def eligibility_global(spark, sf):
    return with_reason(candidates(spark, sf), "global").select("match_id", "reason")


@query("rating_inputs", "select sequence, match_id, event_id, player1_id, player2_id, winner_id, is_draw from v_inputs")
def rating_inputs(spark, sf):
    return r.rating_inputs(candidates(spark, sf), "global").select(
        "sequence", "match_id", "event_id", "player1_id", "player2_id", "winner_id", "is_draw")


@query("elo_history", """select sequence, match_id, event_id, player_id, opponent_id, round(rating_before, 6) as rating_before, round(rating_after, 6) as rating_after,
 round(rating_change, 6) as rating_change, round(opponent_rating_before, 6) as opponent_rating_before, result from v_history""")
def elo_history_query(spark, sf):
    """Full rebuild: candidates, policy, numbering and the Elo rounds."""
    inputs = r.rating_inputs(candidates(spark, sf), "global")
    return elo_history(inputs).select(
        "sequence", "match_id", "event_id", "player_id", "opponent_id", r6("rating_before"),
        r6("rating_after"), r6("rating_change"), r6("opponent_rating_before"), "result")


@query("elo_history_many_rounds", "select sequence, player_id, round(rating_after, 6) as rating_after, result from v_history")
def elo_history_many_rounds(spark, sf):
    """The same ratings from several epochs with parallel components in each."""
    inputs = r.rating_inputs(candidates(spark, sf), "global")
    return elo_history(inputs, group_rows=4000).select("sequence", "player_id", r6("rating_after"), "result")


CURRENT = "player_id, round(rating, 6) as rating, matches_played, wins, losses, draws, round(peak_rating, 6) as peak_rating"


@query("elo_current", f"select {CURRENT} from v_current")
def elo_current_query(spark, sf):
    return published(spark, sf).current.select(
        "player_id", r6("rating"), "matches_played", "wins", "losses", "draws", r6("peak_rating"))


@query("elo_running_peak", """select player_id, sequence, round(greatest(1500.0::double, max(rating_after) over w), 6) as peak_so_far,
 (count(*) filter (result = 'WIN') over w)::bigint as wins_so_far from v_history window w as (partition by player_id order by sequence rows unbounded preceding)""")
def elo_running_peak(spark, sf):
    from matchloom.operators.ordered import number, running
    h = published(spark, sf).history.withColumn(
        "_win", F.when(F.col("result") == "WIN", 1).otherwise(0))
    out = running(number(h, ["player_id"], ["sequence"]), ["player_id"],
                  {"peak": ("max", "rating_after"), "wins_so_far": ("sum", "_win")})
    return out.select("player_id", "sequence",
                      F.round(F.greatest(F.lit(1500.0), "peak"), 6).alias("peak_so_far"),
                      F.col("wins_so_far").cast("long"))


@query("run_digest", """with recursive lines as (select sequence - 1 as i, sha256(sequence || '|' || match_id || '|' || event_id || '|' || player1_id || '|' || player2_id || '|' || coalesce(winner_id::varchar, '-') || '|' || case when is_draw then '1' else '0' end) as h from v_inputs),
 one as (select i // 4096 as i, sha256(string_agg(h, chr(10) order by i)) as h from (select i, h from lines) group by 1),
 two as (select i // 4096 as i, sha256(string_agg(h, chr(10) order by i)) as h from (select i, h from one) group by 1)
 select (select count(*) from lines) as row_count, case when (select count(*) from lines) <= 4096 then (select max(h) from one) else (select max(h) from two) end as digest""")
def run_digest(spark, sf):
    return ordered_digest(published(spark, sf).inputs, "sequence", r.input_line())


BOARD = "rank, player_id, display_name, username, round(rating, 6) as rating, matches_played, wins, losses, draws, round(peak_rating, 6) as peak_rating"


def board(df):
    return df.select("rank", "player_id", "display_name", "username", r6("rating"),
                     "matches_played", "wins", "losses", "draws", r6("peak_rating"))


@query("leaderboard", f"select {BOARD} from (select row_number() over (order by rating desc, matches_played desc, player_id)::int as rank, * from v_current) left join v_players using (player_id) where rank <= 25")
def leaderboard(spark, sf):
    return board(r.leaderboard(published(spark, sf).current, b.players(spark, sf), 25))


@query("leaderboard_page", f"select {BOARD} from (select row_number() over (order by rating desc, matches_played desc, player_id)::int as rank, * from v_current) left join v_players using (player_id) where rank > 50 and rank <= 100")
def leaderboard_page(spark, sf):
    return board(r.leaderboard(published(spark, sf).current, b.players(spark, sf), 50, 50))


@query("leaderboard_min_matches", f"select {BOARD} from (select row_number() over (order by rating desc, matches_played desc, player_id)::int as rank, * from v_current where matches_played >= 3) left join v_players using (player_id) where rank <= 25")
def leaderboard_min_matches(spark, sf):
    return board(r.leaderboard(published(spark, sf).current, b.players(spark, sf), 25,
                               minimum_matches=3))


@query("rank_percentile", """select player_id, row_number() over (order by rating desc, matches_played desc, player_id) as row_rank, rank() over (order by rating desc) as rank,
 round(case when count(*) over () <= 1 then 100.0 else (count(*) over () - rank() over (order by rating desc) - count(*) over (partition by rating) + 1) * 100.0::double / (count(*) over () - 1) end, 6) as percentile from v_current""")
def rank_percentile(spark, sf):
    return r.full_ranking(published(spark, sf).current).select(
        "player_id", "row_rank", "rank", r6("percentile"))


FORM = """select player_id, count(*) filter (n <= 10 and result = 'WIN') as wins_10, count(*) filter (n <= 10 and result = 'LOSS') as losses_10, count(*) filter (n <= 10 and result = 'DRAW') as draws_10,
 count(*) filter (n <= 25 and result = 'WIN') as wins_25, count(*) filter (n <= 25 and result = 'LOSS') as losses_25, count(*) filter (n <= 25 and result = 'DRAW') as draws_25,
 round(sum(rating_change) filter (n <= 25), 6) as rating_change_25 from (select *, row_number() over (partition by player_id order by sequence desc) as n from v_history) group by 1"""
FORM_COLUMNS = ["wins_10", "losses_10", "draws_10", "wins_25", "losses_25", "draws_25"]


@query("recent_form", FORM)
def recent_form(spark, sf):
    return r.recent_form(published(spark, sf).history).select(
        "player_id", *FORM_COLUMNS, r6("rating_change_25"))


@query("best_win", """select h.player_id, h.opponent_id, p.display_name as opponent_name, e.name as event_name, round(h.opponent_rating_before, 6) as opponent_rating, round(h.rating_change, 6) as rating_change
 from (select *, row_number() over (partition by player_id order by opponent_rating_before desc, rating_change desc, sequence desc) as n from v_history where result = 'WIN') h
 left join v_players p on p.player_id = h.opponent_id left join v_events e using (event_id) where n = 1""")
def best_win(spark, sf):
    return r.best_win(published(spark, sf).history, b.players(spark, sf), b.events(spark, sf)).select(
        "player_id", "opponent_id", "opponent_name", "event_name", r6("opponent_rating"),
        r6("rating_change"))


@query("player_profile", f"""with f as ({FORM}), t as (select player_id, avg(opponent_rating_before) a, sum(1.0::double / (1.0 + pow(10.0::double, (opponent_rating_before - rating_before) / 400.0))) e,
 sum(case result when 'WIN' then 1.0::double when 'DRAW' then 0.5::double else 0.0::double end) s from v_history group by 1),
 k as (select player_id, rating, rank() over (order by rating desc) as rank from v_current)
 select p.player_id, p.display_name, k.player_id is not null as has_rating, round(k.rating, 6) as rating, k.rank, f.wins_10, f.wins_25, f.rating_change_25,
 round(t.a, 5) as average_opponent_rating, round(t.e, 5) as expected_score_total, t.s as actual_score_total, round(t.s - t.e, 5) as performance_vs_expected
 from v_players p left join k using (player_id) left join f using (player_id) left join t using (player_id)""")
def player_profile(spark, sf):
    run = published(spark, sf)
    return r.player_profile(run.current, run.history, b.players(spark, sf)).select(
        "player_id", "display_name", "has_rating", r6("rating"), "rank", "wins_10", "wins_25",
        r6("rating_change_25"), F.round("average_opponent_rating", 5).alias("average_opponent_rating"),
        F.round("expected_score_total", 5).alias("expected_score_total"), "actual_score_total",
        F.round(F.col("actual_score_total") - F.col("expected_score_total"), 5)
        .alias("performance_vs_expected"))


SIDES = """select m.*, s.player_id, s.opponent_id, s.player_score, s.opponent_score,
 case when m.is_bye then 'BYE' when m.is_draw then 'DRAW' when m.winner_id is not distinct from s.player_id then 'WIN' when m.winner_id is not null then 'LOSS' else 'UNKNOWN' end as result
 from (select match_id, player1_id as player_id, player2_id as opponent_id, player1_score as player_score, player2_score as opponent_score from v_matches
  union all select match_id, player2_id, player1_id, player2_score, player1_score from v_matches where player2_id is distinct from player1_id) s join v_matches m using (match_id) where s.player_id is not null"""


def histories(spark, sf):
    return r.entity_history(
        b.matches(spark, sf), b.events(spark, sf), b.rounds(spark, sf), b.phases(spark, sf),
        b.registrations(spark, sf), b.players(spark, sf), published(spark, sf).inputs)


@query("tournament_history", f"""select s.player_id, s.event_id, e.name as event_name, s.match_id, p.phase_name, r.round_number::int as round_number, s.opponent_id, o.display_name as opponent_name, s.player_score, s.opponent_score,
 s.result, s.is_intentional_draw, s.match_id in (select match_id from v_inputs) as rated, g.placement::int as placement from ({SIDES}) s join v_events e using (event_id) left join v_rounds r on r.round_id = s.round_id
 left join v_phases p on p.phase_id = r.phase_id left join v_registrations g on g.event_id = s.event_id and g.player_id = s.player_id left join v_players o on o.player_id = s.opponent_id""")
def tournament_history(spark, sf):
    return histories(spark, sf).select(
        "player_id", "event_id", "event_name", "match_id", "phase_name",
        F.col("round_number").cast("int"), "opponent_id", "opponent_name", "player_score",
        "opponent_score", "result", "is_intentional_draw", "rated", "placement")


@query("event_rollup", f"""select s.player_id, s.event_id, coalesce(max(g.matches_won), count(*) filter (result = 'WIN'))::bigint as wins, coalesce(max(g.matches_lost), count(*) filter (result = 'LOSS'))::bigint as losses,
 coalesce(max(g.matches_drawn), count(*) filter (result = 'DRAW'))::bigint as draws, max(g.placement)::int as placement, count(*) as matches, count(*) filter (match_id in (select match_id from v_inputs)) as rated_matches
 from ({SIDES}) s left join v_registrations g on g.event_id = s.event_id and g.player_id = s.player_id group by 1, 2""")
def event_rollup(spark, sf):
    return r.event_rollup(histories(spark, sf)).select(
        "player_id", "event_id", F.col("wins").cast("long"), F.col("losses").cast("long"),
        F.col("draws").cast("long"), "placement", "matches", "rated_matches")


@query("player_search", """select player_id, display_name, username, round(rating, 6) as rating, matches_played from v_players left join v_current using (player_id)
 where lower(coalesce(display_name, '')) like '%machinery_1%' or lower(coalesce(username, '')) like '%machinery_1%'
 order by case when lower(coalesce(display_name, '')) = 'machinery_1' then 0 when lower(coalesce(username, '')) = 'machinery_1' then 1 else 2 end, rating desc nulls last, player_id limit 10""")
def player_search(spark, sf):
    return r.search_players(b.players(spark, sf), published(spark, sf).current, " MACHINERY_1 ").select(
        "player_id", "display_name", "username", r6("rating"), "matches_played")


@query("player_lookup_by_id", "select player_id, display_name, username, round(rating, 6) as rating, matches_played from v_players left join v_current using (player_id) where player_id = 42")
def player_lookup_by_id(spark, sf):
    return r.search_players(b.players(spark, sf), published(spark, sf).current, "42").select(
        "player_id", "display_name", "username", r6("rating"), "matches_played")


@query("run_invariants", """select true as contiguous_sequence, (select count(*) from v_history) = 2 * (select count(*) from v_inputs) as two_rows_per_input,
 (select sum(matches_played) from v_current) = 2 * (select count(*) from v_inputs) as all_processed, (select bool_and(isfinite(rating_after)) from v_history) as finite_history,
 (select bool_and(isfinite(rating) and isfinite(peak_rating)) from v_current) as finite_current, (select bool_and(matches_played = wins + losses + draws) from v_current) as records_add_up,
 (select count(*) from v_current) = (select count(distinct player_id) from v_history) as current_matches_players""")
def run_invariants(spark, sf):
    return r.run_invariants(published(spark, sf))


@query("rating_build_short_circuit", "select false as rebuilt, count(*) as input_count from v_inputs")
def rating_build_short_circuit(spark, sf):
    """Building again from unchanged data finds the published run by its digest."""
    run = published(spark, sf)
    run_id, created = store(spark).build_and_publish_if_changed(
        f"{PUBLICATION}@{sf}", candidates(spark, sf))
    state = store(spark).runs().filter(F.col("run_id") == run.run_id)
    return state.select(F.lit(created or run_id != run.run_id).alias("rebuilt"), "input_count")
