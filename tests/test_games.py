import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchloom.functions.labels import color_pair, colors_label, normalize_outcome, queue_label
from matchloom.plans import games as g
from matchloom.plans import imports as im
from matchloom.plans import openings

COUNT = """member_id long, result string, your_deck_colors array<string>, opponent_deck_colors array<string>,
 queue_id string, queue_name string, mode string, match_format string, ranked boolean, team_observers long, games long"""
AS, AE, AR = ["amber", "steel"], ["amethyst", "emerald"], ["ruby", "amethyst"]


def counts(spark, rows):
    return spark.createDataFrame([(m, res, ["ruby", "sapphire"], opp, "core-bo1", None, None, None, None, obs, n)
                                  for m, res, opp, obs, n in rows], COUNT)


def shown(spark, *ids):
    return spark.createDataFrame([("t", i, f"P{i}") for i in ids], "slug string, member_id long, preferred_display_name string")


def test_labels(spark):
    df = spark.createDataFrame([(["steel", " Amber "],), (["grey"],), ([],), (None,), (["ruby", "ruby"],)], "c array<string>")
    got = df.select(color_pair("c"), colors_label("c")).collect()
    assert [tuple(x) for x in got] == [("Amber/Steel", "Amber/Steel"), ("Unknown", "Grey"), ("Unknown", "Unknown"),
                                       ("Unknown", "Unknown"), ("Ruby", "Ruby")]
    o = spark.createDataFrame([(x,) for x in (" Won", "lost", "TIE", None, "left")], "r string")
    assert [x[0] for x in o.select(normalize_outcome("r")).collect()] == ["win", "loss", "draw", "unknown", "unknown"]


def test_queue_label(spark):
    df = spark.createDataFrame([("core-bo1", None, None, "bo1", True), ("core_infinity", "", "casual", None, False),
                                (None, "Infinity", None, None, None), (None, None, None, None, None)],
                               "queue_id string, queue_name string, mode string, match_format string, ranked boolean")
    assert [x[0] for x in df.select(queue_label()).collect()] == [
        "Core · core-bo1 · bo1 · ranked", "Format unknown · core_infinity · match format unknown · unranked",
        "Infinity · Infinity · match format unknown · rank unknown",
        "Format unknown · Unknown queue · match format unknown · rank unknown"]


def test_matchup_report_leaves_out_internal_games(spark):
    c = counts(spark, [(1, "win", AS, 1, 9), (1, "loss", AS, 1, 1), (2, "lost", AS, 1, 2), (2, None, AS, 1, 3),
                       (2, "won", AS, 2, 4), (3, "win", AS, 1, 50)])
    team = g.matchup_report(c, shown(spark, 1, 2), team=True).collect()
    assert [(x.win, x.loss, x.draw, x.unknown) for x in team] == [(9, 3, 0, 3)]
    assert g.internal_games(c, shown(spark, 1, 2)).first()[0] == 4
    rows = g.matchup_report(c, shown(spark, 1, 2)).collect()
    assert [x.preferred_display_name for x in rows] == ["P1", "P2"]
    with pytest.raises(ValueError):
        g.matchup_report(c, shown(spark, 1), opponent="Steel/Amber")


def extremes(spark, rows):
    out = g.opponent_extremes(g.opponent_records(counts(spark, rows), shown(spark, 1, 2))).collect()
    return {kind: sorted(x.colors for x in out if x.kind == kind) for kind in {x.kind for x in out}}, out


def test_opponent_extremes(spark):
    a, b = "Amber/Steel", "Amethyst/Emerald"
    got, _ = extremes(spark, [(1, "loss", AS, 1, 3), (2, "loss", AS, 1, 4), (1, "loss", AE, 1, 6)])
    assert got["most_losses"] == [a]
    got, _ = extremes(spark, [(1, "loss", AS, 1, 7), (1, "loss", AE, 1, 6), (2, "loss", AE, 1, 1)])
    assert got["most_losses"] == [a, b]
    got, rows = extremes(spark, [(1, "win", AS, 1, 10), (1, "loss", AS, 1, 8), (1, "loss", AE, 1, 1),
                                 (1, "draw", AR, 1, 25), (1, "loss", None, 1, 100)])
    assert got["worst_percentage"] == [b] and got["most_losses"] == [a] and got["unknown"] == ["Unknown"]
    share = {(x.kind, x.colors): x.win_percentage for x in rows}
    assert round(share[("popular", a)], 2) == 55.56 and share[("popular", "Amethyst/Ruby")] is None
    got, _ = extremes(spark, [(1, "draw", AS, 1, 1)])
    assert "most_losses" not in got and "worst_percentage" not in got


def test_weekly_keeps_idle_members(spark):
    c = counts(spark, [(1, "win", AS, 2, 2)])
    got = {x.member_id: (x.colors, x.win, x.games) for x in g.weekly_by_member(c, shown(spark, 1, 2)).collect()}
    assert got == {1: ("Ruby/Sapphire", 2, 2), 2: (None, 0, 0)}


def test_observers_and_latest(spark):
    obs = spark.createDataFrame(
        [(1, 10, 100, "old", dt.datetime(2026, 1, 1), 1), (2, 10, 100, "new", dt.datetime(2026, 1, 2), 2),
         (1, 10, 101, "x", dt.datetime(2026, 1, 1), 3), (5, 20, 100, "y", dt.datetime(2026, 1, 1), 4),
         (6, 99, 100, "stranger", dt.datetime(2026, 1, 1), 5)],
        "account_id long, member_id long, game_id long, result string, last_seen_at timestamp_ntz, event_id long")
    games = spark.createDataFrame([(100, dt.datetime(2026, 1, 1)), (101, dt.datetime(2026, 1, 8))],
                                  "game_id long, started_at timestamp_ntz")
    roster = shown(spark, 10, 20)
    got = {(x.member_id, x.game_id): (x.result, x.team_observers) for x in g.game_results(obs, games, roster).collect()}
    assert got == {(10, 100): ("new", 2), (10, 101): ("x", 1), (20, 100): ("y", 2)}
    half_open = g.game_results(obs, games, roster, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 8))
    assert {x.game_id for x in half_open.collect()} == {100}


def test_member_summary(spark):
    rows = [(1, 1, ["ruby", "sapphire"]), (1, 2, ["sapphire", "ruby"]), (1, 3, ["amber", "steel"]), (1, 4, None), (1, 5, None)]
    res = spark.createDataFrame(rows, "member_id long, game_id long, your_deck_colors array<string>")
    ev = spark.createDataFrame([(1, 1, 0, False), (1, 2, 6, False), (1, 5, 3, False), (1, 3, None, True)],
                               "member_id long, game_id long, mulligan_count int, projection_pending boolean")
    got = {x.member_id: x for x in g.member_summary(res, ev, shown(spark, 1, 2)).collect()}
    x = got[1]
    assert (x.games, x.known_colors, x.top_colors, x.top_count, x.mulligan_average, x.sample, x.pending) == (
        5, 3, "Ruby/Sapphire", 2, 3.0, 3, 1)
    assert (got[2].games, got[2].mulligan_average, got[2].top_colors) == (0, None, None)
    tied = res.filter("game_id in (1, 3)")
    assert g.member_summary(tied, ev, shown(spark, 1)).first().top_colors == "Amber/Steel, Ruby/Sapphire"


def test_missing_read_model_never_falls_back(spark):
    obs = spark.createDataFrame([(1, 7, 100)], "member_id long, account_id long, game_id long")
    t = dt.datetime
    reps = spark.createDataFrame(
        [(7, 100, "valid", "valid", "v1", t(2026, 1, 1), t(2026, 1, 1), 1, 1, 4), (7, 100, "valid", "valid", "v1", t(2026, 1, 2), t(2026, 1, 2), 2, None, None),
         (7, 100, "invalid", "valid", "v1", t(2026, 1, 3), t(2026, 1, 3), 3, 1, 5)],
        "account_id long, game_id long, status string, normalization_status string, parser_version string, fetched_at timestamp_ntz, "
        "created_at timestamp_ntz, normalization_id long, projection_version int, mulligan_count int")
    x = g.latest_evidence(obs, reps, "v1", 1).first()
    assert (x.normalization_id, x.mulligan_count, x.projection_pending) == (2, None, True)


def test_usage_and_status(spark):
    u = spark.createDataFrame([("a", "prefix", 1, True, 12), ("a", "slash", 1, False, 13), ("b", "slash", 2, True, 13)],
                              "command_name string, invocation_mode string, user_id long, succeeded boolean, duration_ms int")
    by = {x.command_name: x for x in g.usage_summary(u, ["command_name"]).collect()}
    assert (by["a"].uses, by["a"].users, by["a"].failures, by["a"].prefix_uses, by["a"].average_ms, by["a"].success_rate) == (2, 1, 1, 1, 12, 50.0)
    total = g.usage_summary(u, []).first()
    assert (total.uses, total.users, total.average_ms) == (3, 2, 13)
    assert g.usage_summary(u.limit(0), []).first().success_rate == 100.0
    m = spark.createDataFrame([(2,), (2,), (3,), (None,), (1,)], "participant_count int")
    assert tuple(g.status_counts(m).first()) == (5, 2, 1, 1)


def test_practice_cap_comes_before_filters(spark):
    rows = [(1, i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), ["ruby"], "win", None) for i in range(6)]
    res = spark.createDataFrame(rows, "member_id long, game_id long, started_at timestamp_ntz, your_deck_colors array<string>, result string, ranked boolean")
    ev = spark.createDataFrame([], "member_id long, game_id long, normalization_id long, mulligan_count int")
    now = dt.datetime(2026, 1, 2)
    got = g.practice_history(res, ev, now, 30, limit=4).collect()
    assert sorted(x.game_id for x in got) == [2, 3, 4, 5] and all(x.truncated for x in got)
    assert g.practice_history(res, ev, now, 30).count() == 6  # no cap unless one is asked for
    assert g.practice_history(res, ev, now, 30, ranked=False).count() == 0
    decks = res.select("member_id", "game_id", F.format_string("%012x", F.col("game_id") % 2).alias("deck_id"), F.lit("Ruby").alias("deck_label"))
    assert g.practice_filter(decks, "0" * 11 + "1").count() == 3
    with pytest.raises(Exception, match="several decks"):
        g.practice_filter(decks.withColumn("deck_id", F.concat(F.lit("a" * 12), "deck_id")), "a" * 12).collect()
    with pytest.raises(ValueError):
        g.practice_history(res, ev, now, 366)


def test_team_ranks_count_rated_members_only(spark):
    roster = shown(spark, 1, 2, 3).withColumn("role", F.lit("member"))
    links = spark.createDataFrame([(1, 11, True), (2, 12, True), (3, 13, False)], "member_id long, player_id long, is_primary boolean")
    cur = spark.createDataFrame([(12, 1500.0, 3), (13, 1900.0, 9)], "player_id long, rating double, matches_played long")
    got = {x.member_id: x.team_rank for x in g.team_leaderboard(roster, links, cur).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_discovery_window(spark):
    rows = [(1, 1, dt.datetime(2026, 9, 13, 1)), (2, 1, dt.datetime(2026, 9, 13, 2)), (3, 2, dt.datetime(2026, 9, 14)),
            (4, 3, None), (5, None, dt.datetime(2026, 9, 13))]
    df = spark.createDataFrame(rows, "ord long, id long, seen timestamp_ntz")
    out = im.select_window_dedup(df, "2026-09-13", "2026-09-14", "id", "seen", "ord")
    assert {x.ord: x.fate for x in out.collect()} == {
        1: "selected", 2: "duplicate", 3: "boundary_excluded", 4: "missing_datetime", 5: "missing_id"}


def test_in_progress_is_vetoed_by_any_finished_column(spark):
    df = spark.createDataFrame([("inProgress", None, None), ("live", "Event_Completed", None), (None, None, "event in-progress"),
                                (None, None, None), ("upcoming", None, None)], "display_status string, event_status string, lifecycle_status string")
    assert [x[0] for x in df.select(im.in_progress()).collect()] == [True, False, True, False, False]


def test_budget_fill(spark):
    own = spark.createDataFrame([(1,), (2,), (2,)], "event_id long")
    rot = spark.createDataFrame([(1, None), (3, 5), (4, None), (5, 2)], "event_id long, at long")
    order = [F.col("at").asc_nulls_first(), F.col("event_id")]
    fill = lambda n: [x.event_id for x in im.budget_fill(own, rot, "event_id", order, n).collect()]
    assert fill(2) == [1, 2] and fill(4) == [1, 2, 4, 5] and fill(9) == [1, 2, 4, 5, 3]


def test_live_message_limit(spark):
    rows = [("s", 1, " Cup ", " u ", n) for n in ("bob", "Ann", "bob")] + [("s", 2, "T" * 400, "u", f"name {i:04}") for i in range(400)]
    df = spark.createDataFrame(rows, "slug string, event_id long, name string, source_url string, preferred_display_name string")
    got = {x.event_id: x.message for x in im.live_message(df).collect()}
    assert got[1] == "**Cup**\nPlaying: Ann, bob\nu"
    assert len(got[2]) <= 2000 and got[2].startswith("**" + "T" * 300 + "**\n") and got[2].endswith("\nu")


def test_opening_reports_leave_out_what_is_unknown(spark):
    replays = spark.createDataFrame(
        [(1, 1, True), (2, 1, False), (3, 1, None), (4, 1, True)],
        "game_id long, member_id long, went_first boolean")
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,)], "game_id long")
    hands = spark.createDataFrame(
        [(1, 7, 3, True, True, True), (2, 0, None, False, True, True), (4, 7, 5, True, True, True)],
        "game_id long, mulligan_count int, post_uninkables int, initial_target boolean, kept_target boolean, "
        "post_target boolean")
    turns = spark.createDataFrame(
        [(1, 2, True, 9, 3, True, False), (2, 2, True, 8, None, None, False), (3, 2, False, None, None, True, None)],
        "game_id long, own_turn long, complete boolean, end_seq long, ink int, target_seen boolean, "
        "target_played boolean")
    got = openings.inspected_openings(replays, rows)
    hand = openings.opening_hand_report(got, hands, ["member_id"]).first()
    assert (hand.inspected, hand.usable, hand.mulligans_known, hand.mulligan_mean) == (4, 3, 2, 3.5)
    assert (hand.full_seven, hand.three_uninkables, hand.three_uninkables_known) == (1, 1, 1)
    turn = openings.opening_turn_report(got, turns, ["member_id"]).first()
    assert (turn.completed, turn.three_ink, turn.three_ink_known) == (2, 1, 1)
    assert (turn.three_ink_first_known, turn.three_ink_second_known) == (1, 0)
    target = openings.opening_target_report(got, hands, turns, ["member_id"]).first()
    assert (target.kept_target, target.kept_target_known, target.played_when_seen_known) == (1, 1, 1)
    assert [r.game_id for r in openings.review_candidates(got, turns, ["member_id"]).collect()] == [1]
    assert openings.opening_hand_report(got.limit(0), hands, ["member_id"]).isEmpty()
