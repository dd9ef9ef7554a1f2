"""Practice opening reports: mulligans and hands, ink by own turn, card targets, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from checks.evidence import OPENING, OWN, TARGETS, opening_rows
from checks.jobs import TARGETS as CARDS
from checks.jobs import HANDS, actions
from matchloom.plans import bindings as b
from matchloom.plans import openings as op
from matchloom.plans import timeline as t
from matchloom.session import materialize


@query("report_practice_openings", """
    select o_orderkey % 5 as member_id, count(*) as inspected, count(*) filter (o_orderkey % 2 = 0) as usable,
        count(*) filter (o_orderkey % 2 = 0) as mulligans_known,
        round(avg((o_orderkey % 3 = 0)::int) filter (o_orderkey % 2 = 0), 6) as mulligan_mean,
        0 as full_seven, count(*) filter (o_orderkey % 2 = 0) as three_uninkables,
        count(*) filter (o_orderkey % 2 = 0) as three_uninkables_known
    from orders where o_orderkey % 17 <> 0 group by 1""")
def report_practice_openings(spark, sf):
    done = materialize(t.opening_columns(actions(spark, sf, HANDS)), "actions")  # folded once, read three times
    replays = done.select("game_id").distinct().withColumn("member_id", F.col("game_id") % 5)
    inspected = op.inspected_openings(replays, t.replay_own_turns(done, 4096, written=True))
    out = op.opening_hand_report(inspected, t.opening_hands(done, CARDS), ["member_id"])
    return out.withColumn("mulligan_mean", F.round("mulligan_mean", 6))


def replays(spark, sf):
    return b.actions(spark, sf).select("game_id").distinct().select(
        "game_id", (F.col("game_id") % 7).alias("member_id"), (F.col("game_id") * 37 % 101).alias("started_at"),
        F.when(F.col("game_id") % 4 != 3, F.col("game_id") % 2 == 0).alias("went_first"))


def inspected(spark, sf, rows):
    return op.inspected_openings(replays(spark, sf), rows)


def hands(spark, sf):
    k = F.col("game_id")
    return b.actions(spark, sf).select("game_id").distinct().select(
        "game_id", F.when(k % 5 != 0, k % 3 != 0).alias("initial_target"),
        F.when(k % 11 != 0, k % 2 == 0).alias("kept_target"), (k % 3 == 1).alias("post_target"))


USABLE = f"""u as (select distinct game_id from ({OWN})), m as ({OPENING}),
    r as (select game_id, game_id % 7 as member_id, game_id * 37 % 101 as started_at,
        case when game_id % 4 <> 3 then game_id % 2 = 0 end as went_first,
        case when game_id % 5 <> 0 then game_id % 3 <> 0 end as initial_target,
        case when game_id % 11 <> 0 then game_id % 2 = 0 end as kept_target,
        game_id % 3 = 1 as post_target from u),
    s as (select r.*, end_seq, target_seen, target_played from r
        left join (select * from m where own_turn = 2 and complete) using (game_id))"""


@query("report_opening_turns", f"""with {USABLE}
    select member_id, own_turn, count(*) as completed, round(avg(ink), 6) as ink_mean,
        count(*) filter (ink >= 3) as three_ink, count(ink) as three_ink_known,
        count(*) filter (went_first and ink >= 3) as three_ink_first,
        count(ink) filter (went_first) as three_ink_first_known,
        count(*) filter (not went_first and ink >= 3) as three_ink_second,
        count(ink) filter (not went_first) as three_ink_second_known
    from r join m using (game_id) where complete group by 1, 2""")
def report_opening_turns(spark, sf):
    rows = opening_rows(spark, sf)
    out = op.opening_turn_report(inspected(spark, sf, rows), t.opening_metrics(rows, TARGETS), ["member_id"])
    return out.withColumn("ink_mean", F.round("ink_mean", 6))


@query("report_practice_targets", f"""with {USABLE}
    select member_id, count(*) filter (initial_target) as initial_target, count(initial_target) as initial_target_known,
        count(*) filter (initial_target and kept_target) as kept_target,
        count(kept_target) filter (initial_target) as kept_target_known,
        count(*) filter (post_target) as post_target, count(post_target) as post_target_known,
        count(*) filter (target_seen) as target_seen, count(target_seen) as target_seen_known,
        count(*) filter (target_played) as target_played, count(target_played) as target_played_known,
        count(*) filter (target_seen and target_played) as played_when_seen,
        count(target_played) filter (target_seen) as played_when_seen_known,
        count(*) filter (target_seen and not target_played) as review_candidates
    from s group by 1""")
def report_practice_targets(spark, sf):
    rows = opening_rows(spark, sf)
    return op.opening_target_report(inspected(spark, sf, rows), hands(spark, sf),
                                    t.opening_metrics(rows, TARGETS), ["member_id"])


@query("opening_candidates", f"""with {USABLE}
    select member_id, game_id, end_seq from (select *, row_number() over (
        partition by member_id order by started_at desc, game_id) as n
        from s where target_seen and not target_played) where n <= 5""")
def opening_candidates(spark, sf):
    rows = opening_rows(spark, sf)
    return op.review_candidates(inspected(spark, sf, rows), t.opening_metrics(rows, TARGETS), ["member_id"], 5).select(
        "member_id", "game_id", "end_seq")
