"""The action table of replays: late abilities, choices, prompts, challenges, game facts, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query
from matchloom.plans import bindings as b
from matchloom.plans import features as ft
from matchloom.session import materialize
from matchloom.sources import archives as a


def states(spark, sf):
    return a.replay_states(b.ability_archives(spark, sf))


def actions(spark, sf):
    return a.normalize_actions(states(spark, sf))


P = "from (select p_partkey as p from part)"
#: the frame that fills the ability's card: its own, one that follows, or none behind a frame that answers nothing
FILLED = "p % 7 <> 0 and p % 5 in (1, 2, 3)"


@query("replay_followups", f"""
    select p as game_id, case when p % 7 = 0 then '9-9' when p % 5 < 4 then '8-' || (p % 3) end as card_id,
        case when p % 7 = 0 then 'Known' when p % 5 < 4 then 'Lamp' end as card_name,
        case when p % 5 = 0 or {FILLED} then 'Glow' end as ability_name,
        case when {FILLED} then p % 5 + 2 end::bigint as derived_from_followup_seq,
        p % 5 = 0 or {FILLED} as derived_from_logs {P}""")
def replay_followups(spark, sf):
    return actions(spark, sf).filter(F.col("type") == "activate_ability").select(
        "game_id", "card_id", "card_name", "ability_name", "derived_from_followup_seq", "derived_from_logs")


@query("replay_choices", f"""
    select p as game_id, i::bigint as seq, case when hit then 0 else 1 end::int as choices,
        case when not hit then 'Bob chose "Left ' || i || '"' end as message,
        case when not hit and p % 3 = 0 then 'Left ' || i end as option,
        case when not hit and p % 3 <> 0 then '7-' || i end as card, '9-1' as source_card,
        case when i = 4 then 'q1:1:2:["h1"]' end as visible, true as opponent_pending
    from (select p, i, i = least(p % 5, 3) + 2 as hit {P}, range(3, 6) r(i) where not (i = 4 and p % 5 = 4))""")
def replay_choices(spark, sf):
    first = F.get("choices", F.lit(0))
    shown = F.get("prompt.prompts", F.lit(0))
    return actions(spark, sf).filter(F.col("type") == "choice").select(
        "game_id", "seq", F.size("choices").alias("choices"), first["message"].alias("message"),
        first["option"].alias("option"), F.get(first["cards"], F.lit(0))["id"].alias("card"),
        F.col("prompt.source_card.id").alias("source_card"),
        F.when(shown.isNotNull(), F.concat_ws(":", shown["id"], shown["min_select"], shown["max_select"],
                                              shown["valid_targets"])).alias("visible"),
        F.col("prompt.opponent_pending").alias("opponent_pending"))


@query("replay_challenges", f"""
    select p as game_id, 'a1' as card_instance_id, 'd1' as target_instance_id, 'Def' as target_name,
        'perspective:field' as attacker_before, 'opponent:field' as defender_before,
        case when p % 2 = 0 then 'opponent:discard' else 'opponent:field' end as defender_after,
        case when p % 2 = 0 then 1 else 2 end::int as damage_after,
        3::int as damage_to_defender, 2::int as damage_to_attacker,
        case when p % 2 = 0 then 'defender_banished' else 'neither_banished' end as challenge_outcome,
        (p % 4)::int as challenger_bonus, (p % 4 + 3)::int as defender_total, 'hit' as resolution_message,
        1::int as own_field, 1::int as opponent_field, 53::int as deck_count {P}""")
def replay_challenges(spark, sf):
    at = lambda c: F.concat_ws(":", f"challenge.{c}.owner", f"challenge.{c}.zone")
    return actions(spark, sf).filter(F.col("type") == "challenge").select(
        "game_id", "card_instance_id", "target_instance_id", "target_name", at("attacker.before").alias("attacker_before"),
        at("defender.before").alias("defender_before"), at("defender.after").alias("defender_after"),
        F.col("challenge.defender.after.card.damage").alias("damage_after"), "challenge.damage_to_defender",
        "challenge.damage_to_attacker", "challenge_outcome",
        F.col("challenge.combat.attacker_challenger_bonus").alias("challenger_bonus"),
        F.col("challenge.combat.defender_total_damage").alias("defender_total"), "challenge.resolution_message",
        F.size("board.field").alias("own_field"), F.size("board.opponent_field").alias("opponent_field"),
        "board.deck_count")


@query("replay_songs", f"""
    select p as game_id, '5-6' as card_id, 'sing' as play_method, '5-7' as singer, 'hand' as source, 'song' as card_type,
        'Ann' as active_player_name, 'CARD_PLAYED' as log_type, '5-6,5-7' as log_cards {P}""")
def replay_songs(spark, sf):
    return actions(spark, sf).filter(F.col("type") == "play").select(
        "game_id", "card_id", "play_method", F.col("singer.id").alias("singer"), "source", "card_type", "active_player_name",
        F.get("logs.type", F.lit(0)).alias("log_type"), F.array_join(F.get("logs.cards", F.lit(0))["id"], ",").alias("log_cards"))


WARNED = "array_to_string(list_filter([case when p % 6 = 0 then 'mulligan_count_differs' end, case when p % 10 = 9 then 'no_starting_player' end, case when p % 4 = 0 then 'winner_differs' end], lambda x: x is not null), ',')"


@query("replay_games", f"""
    select p as game_id, 'rp' || p as replay_id, 'Ann' as perspective_name, (p % 2 + 1)::int as first_player,
        case when p % 4 = 0 then 2 else 1 end::int as winner, 'lore' as victory_reason, 7::int as starting_hand,
        '1-0,3-1' as decklist, case when p % 6 = 0 then 1 else 0 end::int as logged_mulligan,
        case when p % 2 = 0 then 0 else 1 end::int as last_opponent_field, {WARNED} as warnings,
        {WARNED} = '' as opening_eligible {P}""")
def replay_games(spark, sf):
    folded = states(spark, sf)
    eligible = a.normalize_actions(folded).groupBy("game_id").agg(F.bool_and("opening_eligible").alias("opening_eligible"))
    return a.normalize_games(folded).join(eligible, "game_id").select(
        "game_id", "replay_id", "perspective_name", "first_player", "winner", "victory_reason",
        F.size("starting_hand").alias("starting_hand"), F.array_join("decklist", ",").alias("decklist"),
        F.col("mulligan_log.count").alias("logged_mulligan"),
        F.size("final_state.opponent_field").alias("last_opponent_field"),
        F.array_join("warnings", ",").alias("warnings"), "opening_eligible")


@query("game_features", f"""
    select p as game_id, p % 2 = 0 as went_first, p % 4 <> 0 as won,
        case when p % 5 = 4 then 2 else 3 end as choices, case when p % 5 = 4 then null else 1 end::bigint as own_choices,
        7::int as own_actions, 1::int as own_turns, 1::bigint as start_seq, 7::int as start_hand, 0::int as start_ink,
        6::int as turn_actions, case when p % 7 = 0 then '9-9' when p % 5 < 4 then '8-' || (p % 3) end as ability_card,
        0::int as mulligan, 7::int as kept, (select count(*) from (select unnest(string_split({WARNED}, ',')) as w) where w <> '')::int as warnings {P}""")
def game_features(spark, sf):
    folded = materialize(states(spark, sf), "states")  # folded once, read for actions and games
    rows = ft.extract_features(a.normalize_actions(folded), a.normalize_games(folded))
    turn = F.get("own_turns", F.lit(0))
    ability = F.get(F.filter("own_actions", lambda x: x["type"] == "activate_ability"), F.lit(0))
    return rows.select(
        "game_id", "went_first", "won", F.col("action_counts")["choice"].alias("choices"),
        F.try_element_at("own_action_counts", F.lit("choice")).alias("own_choices"), F.size("own_actions").alias("own_actions"),
        F.size("own_turns").alias("own_turns"), turn["start"]["seq"].alias("start_seq"),
        F.size(turn["start"]["hand"]).alias("start_hand"), turn["start"]["ink_count"].alias("start_ink"),
        F.size(turn["actions"]).alias("turn_actions"), ability["card_id"].alias("ability_card"),
        F.col("mulligan.count").alias("mulligan"), F.size("mulligan.kept").alias("kept"),
        F.col("warning_count").alias("warnings"))
