import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.plans import ratings as r
from matchloom.plans.elo import check_parameters, elo_current, elo_history
from matchloom.plans.policies import policy_name, register_policy, with_reason

CANDIDATE = """match_id long, event_id long, round_id long, player1_id long, player2_id long,
 winner_id long, is_draw boolean, match_status string, is_bye boolean, is_ghost_match boolean,
 participant_count int, event_start_datetime timestamp_ntz, event_format string,
 event_sync_state string, phase_order int, round_number int"""
FIELDS = [f.split()[0] for f in CANDIDATE.replace("\n", "").split(",")]
BASE = dict(match_id=1, event_id=10, round_id=100, player1_id=1, player2_id=2, winner_id=1,
            is_draw=False, match_status="COMPLETE", is_bye=False, is_ghost_match=False,
            participant_count=2, event_format="Core Constructed", event_sync_state="complete",
            phase_order=0, round_number=1)
import datetime as dt  # noqa: E402

BASE["event_start_datetime"] = dt.datetime(2026, 1, 1)
CASES = [
    ({}, "included", "included"),
    ({"match_status": "PENDING"}, "match_not_complete", None),
    ({"match_status": None}, "match_not_complete", None),
    ({"is_bye": True}, "bye", None),
    ({"is_ghost_match": True}, "ghost_match", None),
    ({"participant_count": 3}, "not_two_player", None),
    ({"participant_count": None}, "not_two_player", None),
    ({"player1_id": None}, "missing_player", None),
    ({"player2_id": 1}, "same_player", None),
    ({"winner_id": None}, "missing_result", None),
    ({"winner_id": None, "is_draw": True}, "included", None),
    ({"winner_id": 9}, "invalid_winner", None),
    ({"event_start_datetime": None}, "missing_event_start", None),
    ({"event_sync_state": "partial"}, "included", "event_not_complete"),
    ({"event_sync_state": None}, "included", "event_not_complete"),
    ({"event_format": "Draft"}, "included", "unsupported_event_format"),
    ({"event_format": None}, "included", "unsupported_event_format"),
    ({"is_bye": True, "match_status": "PENDING"}, "match_not_complete", None),
]


def test_policies(spark):
    rows = [tuple({**BASE, **change, "match_id": i}[f] for f in FIELDS)
            for i, (change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, CANDIDATE)
    legacy = {x.match_id: x.reason for x in with_reason(df, "legacy").collect()}
    strict = {x.match_id: x.reason for x in with_reason(df, "global").collect()}
    for i, (change, a, b) in enumerate(CASES):
        assert legacy[i] == a, change
        assert strict[i] == (b or a), change


def test_policy_registry(spark):
    assert policy_name(" GLOBAL ") == "global_elo_v1"
    with pytest.raises(ValueError):
        policy_name("other")
    register_policy("only_even_v1", lambda: [("odd", F.col("match_id") % 2 == 1)])
    df = spark.createDataFrame([(1,), (2,)], "match_id long")
    assert [x.reason for x in with_reason(df, "only_even_v1").orderBy("match_id").collect()] == ["odd", "included"]


INPUT = "sequence long, match_id long, event_id long, player1_id long, player2_id long, winner_id long, is_draw boolean"


def plain_loop(rows, start=1500.0, k=32.0):
    rating, out = {}, []
    for s, m, e, p, q, w, d in sorted(rows):
        if p is None or q is None or p == q or not (d or w in (p, q)):
            continue
        a, b = rating.get(p, start), rating.get(q, start)
        score = 0.5 if d else 1.0 if w == p else 0.0
        ea, eb = 1 / (1 + 10 ** ((b - a) / 400)), 1 / (1 + 10 ** ((a - b) / 400))
        rating[p], rating[q] = a + k * (score - ea), b + k * ((1 - score) - eb)
        out += [(s, p, a, rating[p], b), (s, q, b, rating[q], a)]
    return sorted(out)


def folded(spark, rows, **kw):
    h = elo_history(spark.createDataFrame(rows, INPUT), **kw)
    return sorted((x.sequence, x.player_id, x.rating_before, x.rating_after,
                   x.opponent_rating_before) for x in h.collect())


def test_win_between_equals(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 2, 1, False), (2, 2, 1, 1, 2, 1, True)], INPUT)
    h = elo_history(df)
    first = {x.player_id: x for x in h.filter("sequence = 1").collect()}
    assert (first[1].rating_after, first[2].rating_after) == (1516.0, 1484.0)
    assert (first[1].result, first[2].result) == ("WIN", "LOSS")
    now = {x.player_id: x for x in elo_current(h).collect()}
    assert now[1].rating < 1516 and now[1].rating + now[2].rating == 3000
    assert now[1].draws == 1 and now[2].peak_rating == 1500 and now[1].peak_rating == 1516


def test_unusable_rows_create_no_players(spark):
    rows = [(1, 1, 1, 1, 2, 3, False), (2, 2, 1, 1, 2, None, False), (3, 3, 1, 1, 1, 1, False)]
    assert folded(spark, rows) == []


@pytest.mark.parametrize("k", [0, -1, math.nan, math.inf])
def test_parameters(k):
    with pytest.raises(ValueError):
        check_parameters(1500.0, k)


def random_rows(n, players, hot=0.0, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(1, n + 1):
        p = 0 if rnd.random() < hot else rnd.randrange(players)
        q = rnd.randrange(players)
        draw = rnd.random() < 0.1
        rows.append((i, 1000 + i, i % 7, p, q, None if draw else rnd.choice([p, q]), draw))
    return rows


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_parallel_rounds_equal_the_plain_loop(spark, hot):
    """Many epochs, several components, and components cut by size."""
    rows = random_rows(240, 60, hot)
    assert folded(spark, rows, group_rows=40, per_player=1.5) == plain_loop(rows)


def test_single_round_equals_the_plain_loop(spark):
    rows = random_rows(500, 30, 0.3, 7)
    assert folded(spark, rows) == plain_loop(rows)


def test_rank_and_percentile(spark):
    df = spark.createDataFrame([(1, 1500.0, 4), (2, 1500.0, 6), (3, 1600.0, 1), (4, 1400.0, 1)],
                               "player_id long, rating double, matches_played long")
    got = {x.player_id: x for x in r.full_ranking(df).collect()}
    assert (got[1].total, got[1].above, got[1].below) == (4, 1, 1)
    assert got[1].rank == got[2].rank == 2 and round(got[1].percentile, 2) == 33.33
    assert (got[3].row_rank, got[2].row_rank, got[1].row_rank) == (1, 2, 3)
    assert r.full_ranking(df.filter("player_id = 4")).first().percentile == 100.0


def test_leaderboard_bounds_and_deep_pages(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 5), i) for i in range(40)],
                               "player_id long, rating double, matches_played long").withColumn(
        "wins", F.lit(0)).withColumn("losses", F.lit(0)).withColumn("draws", F.lit(0)).withColumn(
        "peak_rating", F.lit(0.0))
    players = df.select("player_id", F.lit("n").alias("display_name"), F.lit("u").alias("username"))
    near = sorted((x["rank"], x.player_id) for x in r.leaderboard(df, players, 10, 12).collect())
    monkeypatch.setattr(r, "DEEP_PAGE", 0)
    assert near == sorted((x["rank"], x.player_id) for x in r.leaderboard(df, players, 10, 12).collect())
    assert [n for n, _ in near] == list(range(13, 23))
    for bad in (dict(limit=0), dict(limit=501), dict(offset=-1)):
        with pytest.raises(ValueError):
            r.leaderboard(df, players, **bad)


def candidates(spark, n=40):
    rows = []
    for s, m, e, p, q, w, d in random_rows(n, 8):
        rows.append(tuple({**BASE, "match_id": m, "event_id": e, "player1_id": p, "player2_id": q,
                           "winner_id": w, "is_draw": d}[f] for f in FIELDS))
    return spark.createDataFrame(rows, CANDIDATE)


def test_run_store_lifecycle(spark, tmp_path):
    store = r.RunStore(spark, str(tmp_path / "runs"))
    first, created = store.build_and_publish_if_changed("board", candidates(spark))
    assert created and store.published("board").run_id == first
    again, created = store.build_and_publish_if_changed("board", candidates(spark))
    assert (again, created) == (first, False)
    second, _ = store.build_and_publish_if_changed("board", candidates(spark, 44))
    third, _ = store.build_and_publish_if_changed("board", candidates(spark, 48))
    row = store.publications().first()
    assert (row.current_run, row.previous_run, row.version) == (third, second, 3)
    assert not (tmp_path / "runs" / f"run_id={first}").exists()
    assert store.open(second).history.count() > 0
    assert all(r.run_invariants(store.open(third)).first())
    back, created = store.build_and_publish_if_changed("board", candidates(spark))  # the first run is gone
    assert created and back != first and store.published("board").history.count() > 0
    assert not store.prune()
    with pytest.raises(ValueError):
        store.publish("board", "nothing")


def test_failed_build_keeps_the_publication(spark, tmp_path, monkeypatch):
    store = r.RunStore(spark, str(tmp_path / "runs"))
    first, _ = store.build_and_publish_if_changed("board", candidates(spark))
    monkeypatch.setattr(r, "elo_current", lambda *a: (_ for _ in ()).throw(RuntimeError("x" * 5000)))
    with pytest.raises(RuntimeError):
        store.build_and_publish_if_changed("board", candidates(spark, 50))
    assert store.published("board").run_id == first
    failed = store.runs().filter("status = 'failed'").first()
    assert len(failed.note) == 4000


def test_player_search(spark):
    players = spark.createDataFrame([(1, "Ann", "x"), (2, "Joanna", "ann"), (3, "Hanna", "y"), (12, None, "z")],
                                    "player_id long, display_name string, username string")
    current = spark.createDataFrame([(3, 1600.0, 5), (2, 1500.0, 2)],
                                    "player_id long, rating double, matches_played long")
    assert [x.player_id for x in r.search_players(players, current, " ann ").collect()] == [1, 2, 3]
    assert [x.player_id for x in r.search_players(players, current, "12").collect()] == [12]
    assert [x.player_id for x in r.search_players(players, current, "h_nna").collect()] == [3]
