"""Costly rows are made once: folded replays, cards of a state, decks of order lines."""

import json
import random

from pyspark.sql import functions as F

from checks import QUERIES, openings, sinks
from matchloom.plans import bindings as b
from matchloom.plans import features as ft
from matchloom.plans import timeline as t
from matchloom.sources import archives as a

SF = "/root/testdata/sf0.001"


def counted(df, seen):
    """The same rows; ``seen`` counts how often one is made."""
    def run(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame
    return df.mapInPandas(run, df.schema)


def test_own_turns_read_actions_once(spark):
    rows = [(g, s, "play", True, 1, 1, 1, 1, "1-1", "Card", [], 0, 0, False, True) for g in range(20) for s in range(1, 5)]
    some = spark.createDataFrame(rows, "game_id long, seq long, type string, actor_is_perspective boolean, perspective int, "
                                 "game_first_player int, segment_player int, gameplay_turn int, card_id string, card_name string, "
                                 "hand array<string>, ink_count int, ready_ink int, undone boolean, opening_eligible boolean")
    seen = spark.sparkContext.accumulator(0)
    turns = t.replay_own_turns(counted(some.repartition(4), seen), 16)
    assert turns.filter("own_turn = 1").count() == 80 and seen.value == 80


def test_opening_report_folds_replays_once(spark, monkeypatch):
    seen, archives = spark.sparkContext.accumulator(0), b.archives(spark, SF)
    monkeypatch.setattr(openings.b, "archives", lambda *_: counted(archives, seen))
    assert QUERIES["report_practice_openings"](spark, SF).count() == 5
    assert seen.value == archives.count()


def test_decks_are_made_once(spark, monkeypatch):
    seen, table = spark.sparkContext.accumulator(0), sinks.table
    monkeypatch.setattr(sinks, "table", lambda *x: counted(table(*x), seen))
    QUERIES["decklist_rows"](spark, SF).count()
    assert seen.value == table(spark, SF, "lineitem").count()


def test_left_out_cards_are_null_and_all_else_stays(spark):
    archives = b.ability_archives(spark, SF)
    whole, slim = a.replay_states(archives), a.replay_states(archives, ("hand",))
    assert whole.schema == slim.schema
    plain = [c for c in whole.selectExpr("inline(states)").columns if c == "hand" or c not in a.CARD_FIELDS]
    of = lambda df: sorted(df.selectExpr("game_id", "state_error", "game.warnings", "posexplode(states) as (i, s)").select(
        "game_id", "state_error", "warnings", "i", *[f"s.{c}" for c in plain]).toPandas().astype(str).values.tolist())
    assert of(whole) == of(slim)
    row = slim.select("states.field", "game.final_state", "game.starting_hand").first()
    assert set(row.field) == {None} and row.final_state is None and row.starting_hand is None


def _plain(monkeypatch, body):
    """The fold with every zone and card read again each time."""
    with monkeypatch.context() as m:
        m.setattr(a._Table, "seen", property(lambda self: {}, lambda self, value: None), raising=False)
        m.setattr(a._Table, "card", lambda self, card: a._card(card), raising=False)
        zone = a._Table.zone

        def fresh(self, who, name):
            kept = {}
            m.setattr(a._Table, "seen", property(lambda self: kept, lambda self, value: None), raising=False)
            return zone(self, who, name)
        m.setattr(a._Table, "zone", fresh)
        return a._fold(body)


def test_kept_cards_follow_patches(monkeypatch):
    draw = random.Random(5)
    card = lambda i: {"id": f"1-{i}", "instanceId": f"h{i}", "cost": i, "damage": 0, "cardsUnder": [1] * (i % 3)}
    for _ in range(40):
        def patch():
            who, zone = draw.choice(["myPlayer", "opponent"]), draw.choice(["hand", "field", "discard"])
            return draw.choice([
                {"op": "replace", "path": f"/{who}/{zone}/0/damage", "value": draw.randrange(9)},
                {"op": "add", "path": f"/{who}/{zone}/0/cardsUnder/-", "value": 1},
                {"op": "add", "path": f"/{who}/{zone}/1", "value": card(draw.randrange(9))},
                {"op": "add", "path": f"/{who}/{zone}/-", "value": card(draw.randrange(9))},
                {"op": "remove", "path": f"/{who}/{zone}/2"},
                {"op": "add", "path": f"/{who}/inkwell/-", "value": {"exerted": draw.choice([0, False, True]), "card": card(3)}},
                {"op": "replace", "path": f"/{who}/inkwell/0/card/damage", "value": draw.randrange(9)},
                {"op": "replace", "path": f"/{who}/{zone}", "value": [card(4), card(5), card(6)]},
                {"op": "replace", "path": "/turnNumber", "value": 2}])
        side = lambda: {z: [card(i) for i in range(4)] for z in ("hand", "field", "discard")} | {
            "inkwell": [{"exerted": False, "card": card(1)}]}
        body = {"perspective": 1, "baseSnapshot": {"myPlayer": side(), "opponent": side()}, "frames": [
            {"player": 1, "actionType": "QUEST", "patch": [patch() for _ in range(3)]} for _ in range(8)]}
        text, made = json.dumps(body), []
        expected = json.dumps(_plain(monkeypatch, json.loads(text)))
        with monkeypatch.context() as m:
            make = a._card
            m.setattr(a, "_card", lambda c: made.append(1) or make(c))
            assert json.dumps(a._fold(json.loads(text))) == expected
        assert made


def test_untouched_cards_are_read_once(monkeypatch):
    made, make = [], a._card
    monkeypatch.setattr(a, "_card", lambda c: made.append(1) or make(c))
    cards = [{"id": f"1-{i}", "instanceId": f"h{i}"} for i in range(7)]
    add = {"op": "add", "path": "/myPlayer/hand/-", "value": {"id": "2-1"}}
    a._fold({"perspective": 1, "baseSnapshot": {"myPlayer": {"hand": cards}}, "frames": [
        {"player": 1, "actionType": "QUEST", "patch": [dict(add, value={"id": f"2-{i}"})]} for i in range(5)]})
    assert len(made) == 7 + 5  # all cards once, though the hand changed in every frame


def test_typed_states_equal_those_that_are_handed_on_as_text(spark):
    bodies = [r.body for r in b.ability_archives(spark, SF).limit(30).collect()]
    odd = json.loads(bodies[0])
    odd["baseSnapshot"]["myPlayer"]["hand"][0] |= {"cost": "3", "colors": "Ruby", "inkable": 1, "lore": 2.0}
    rows = list(enumerate(bodies))
    of = lambda rows: {r.game_id: r for r in a.replay_states(spark.createDataFrame(
        rows, "game_id long, body string").coalesce(1)).collect()}
    typed, text = of(rows), of([*rows, (99, json.dumps(odd))])
    assert all(typed[i] == text[i] for i in range(30))
    card = text[99].states[1].hand[0]
    assert (card.id, card.name, card.cost, card.inkable, card.lore) == ("1-0", "Card 0", None, None, None)


def test_states_are_handed_on_with_their_types():
    import pyarrow as pa
    body = {"format": a.FORMAT, "perspective": 1, "baseSnapshot": {"myPlayer": {"hand": [{"id": "1-1", "cost": 2}]}},
            "frames": [{"seq": i, "player": 1, "actionType": "QUEST"} for i in range(3)]}
    batch = pa.RecordBatch.from_pydict({"game_id": [1, 2, 3], "body": [json.dumps(body), "{}", json.dumps(body | {"frames": []})]})
    out = next(a._folded([batch]))
    states = out.column("states").to_pylist()
    assert out.column("folded").null_count == 3 and [len(x) if x is not None else None for x in states] == [3, None, 0]
    assert [(c["id"], c["cost"], c["cards_under"]) for c in states[0][2]["hand"]] == [("1-1", 2, 0)]


def test_large_bodies_are_folded_a_few_at_a_time(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(a, "BYTES_AT_ONCE", 100)
    bodies = ["x" * 60, "x" * 30, "x" * 500, None, "x" * 99, "x"]
    parts = [p.num_rows for p in a._portions(pa.RecordBatch.from_pydict({"game_id": list(range(6)), "body": bodies}))]
    assert parts == [2, 1, 3]


def test_short_games_are_not_sorted_by_range(spark, monkeypatch):
    rows = [(g, s, "undo" if s % 7 == 3 else "play", (s + g) // 2 % 2 + 1, (s + g) // 4 + 1 - g // 4) for g in range(12) for s in range(3 + 2 * g)]
    rows += [(None, s, "play", 1, 1) for s in range(4)]
    some = spark.createDataFrame(rows, "game_id long, seq long, type string, active_player int, turn_label int")
    of = lambda size: sorted(map(repr, t.own_turns(some, 1, 1, size).collect()))
    blocks = sorted(map(repr, t._turns_in_blocks(some, F.lit(1), F.lit(1), 5).select(*some.columns, "own_turn", "counts").collect()))
    assert of(5) == blocks and blocks  # long games in blocks, short ones in tasks
    monkeypatch.setattr(t, "number", lambda *x: 1 / 0)
    assert of(100) == blocks


def test_features_read_actions_once(spark):
    folded = a.replay_states(b.ability_archives(spark, SF))
    actions, seen = a.normalize_actions(folded).cache(), spark.sparkContext.accumulator(0)
    plain = actions.select("game_id", "seq", "type", "gameplay_turn", "actor", "actor_is_perspective", "card_id", "card_name",
                           "card_instance_id", "source", "ability_name", "lore_gained", "hand", "hand_count", "ink_count", "ready_ink",
                           "lore", "undone", "mulligan_hand", "mulligan_sent", "mulligan_kept", "mulligan_drawn")
    rows = ft.extract_features(counted(plain, seen), a.normalize_games(folded)).collect()
    assert seen.value == actions.count() and len(rows) == folded.count() and all(len(r.own_actions) == 7 for r in rows)


def test_features_of_every_game_are_whole(spark):
    rows = QUERIES["replay_features"](spark, SF).collect()
    one = {r.type: r for r in rows if r.game_id == 6}
    swap = one["mulligan"]
    assert (swap.mulligan, swap.kept, swap.went_first, swap.own_turns, swap.start_seq, swap.start_hand) == (1, 6, True, swap.own_turns, 1, 7)
    assert swap.own_turns >= 1 and sum(r.own_actions for r in one.values()) == swap.own_action_rows


def test_highest_scores_come_in_order():
    import numpy as np
    from matchloom.plans import retrieval
    scores = np.random.default_rng(2).integers(0, 4, (50, 30))
    for k in (1, 2, 60):
        assert (retrieval._highest(scores, k) == np.argsort(-scores, axis=0, kind="stable")[:k]).all()
