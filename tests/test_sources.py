import datetime as dt
import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions import times as tm
from matchloom.plans import cards as c
from matchloom.plans import timeline as t
from matchloom.plans.periods import current_period
from matchloom.plans.retrieval import retrieve_pages
from matchloom.sources import archives as a
from matchloom.sources import conform as cf
from matchloom.sources import documents as doc
from matchloom.sources.history import parse_history
from matchloom.sources.pages import extract_embedded_json


def push(text):
    return "self.__next_f.push(" + json.dumps([1, text]) + ")"


def test_embedded_json(spark):
    obj = json.dumps({"id": 5, "name": 'a "b"\n{c}', "x": {"y": [1]}})
    cases = [("<s>" + push("pre " + obj + " post"), None), (push(obj[:9]) + push(obj[9:]), None),
             ("x " + obj, None), (push(obj.replace("5", "6", 1)), "not_found"),
             ("self.__next_f.push([1,", "invalid_chunk"), (push('{"id":5, oops'), "invalid_object"), ("", "not_found")]
    df = spark.createDataFrame([(i, 5, h) for i, (h, _) in enumerate(cases)], "page_id long, event_id long, html string")
    got = {x.page_id: x for x in extract_embedded_json(df).collect()}
    for i, (_, error) in enumerate(cases):
        assert got[i].error == error
        if error is None:
            assert json.loads(got[i].json)["name"] == 'a "b"\n{c}'


def test_match_documents(spark):
    rel = lambda *ids: [{"player": {"id": i}} for i in ids]
    docs = [dict(id=1, status="COMPLETE", winning_player=2, games_won_by_winner=2, games_won_by_loser=1, player_match_relationships=rel(1, None, 1, 2)),
            dict(id=2, status="COMPLETE", winning_player={"id": 9}, games_won_by_winner=2, player_match_relationships=rel(1, 2, 3)),
            dict(id=3, status="COMPLETE", player_match_relationships=rel(1)), dict(id=4, status="COMPLETE", match_is_bye=True),
            dict(id=5, match_is_unintentional_draw=True, winning_player=1, player_match_relationships=rel(1, 2)), dict(status="COMPLETE")]
    df = spark.createDataFrame([(1, 1, json.dumps(d)) for d in docs], "event_id long, round_id long, body string")
    got = {x.match_id: x for x in doc.flatten_matches(df).collect()}
    pick = lambda m: (got[m].player1_id, got[m].player2_id, got[m].participant_count, got[m].winner_id, got[m].player1_score, got[m].player2_score, got[m].is_draw)  # noqa: E731,E501
    assert pick(1) == (1, 2, 2, 2, 1, 2, False)
    assert pick(2) == (1, 2, 3, 9, None, None, False)
    assert pick(3) == (1, None, 1, None, None, None, True)
    assert pick(4) == (None, None, 0, None, None, None, False)
    assert pick(5)[-1] is True and len(got) == 5


def test_history_kinds(spark):
    bodies = ['{"game_id":" g ","ranked":1,"match_game_number":2,"started_at":1700000000000,"your_deck_colors":"Ruby/ STEEL/"}',
              '{"game_id":"g","ranked":"x","match_game_number":true,"started_at":"2026-01-01T00:00:00","your_deck_colors":[1]}',
              '{"game_id":"g","started_at":"2026-01-01T02:00:00+02:00","your_deck_colors":[" Amber"],"opp_deck_colors":[]}', "nonsense", '{"game_id":"  "}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    r = {x.i: x for x in parse_history(df).withColumn("s", F.unix_seconds("started_at")).collect()}
    assert (r[0].game_id, r[0].ranked, r[0].match_game_number, r[0].s, r[0].your_deck_colors, r[0].errors) == ("g", True, 2, 1700000000, ["ruby", "steel"], [])
    assert sorted(r[1].errors) == ["match_game_number", "ranked", "started_at", "your_deck_colors"]
    assert (r[2].s, r[2].your_deck_colors, r[2].opp_deck_colors, r[2].errors) == (1767225600, ["amber"], [], [])
    assert r[3].errors == ["document"] and r[4].errors == ["game_id"]


def test_patches():
    s = {"a": {"l": [1, 2]}}
    s = a.set_path(s, "replace", "/a/new", 5)
    s = a.set_path(s, "remove", "/a/none", None)
    s = a.set_path(s, "replace", "/a/l/2", 3)
    s = a.set_path(s, "add", "/a/l/-", 4)
    s = a.set_path(s, "add", "/a/l/0", 0)
    s = a.set_path(s, "remove", "/a/l/9", None)
    s = a.set_path(s, "add", "/x~1y/z", 1)
    assert s == {"a": {"l": [0, 1, 2, 3, 4], "new": 5}, "x/y": {"z": 1}}
    for op, path in (("replace", "/a/l/7"), ("replace", "/a/l/-"), ("move", "/a")):
        with pytest.raises((IndexError, ValueError)):
            a.set_path(s, op, path, 1)


def test_archives(spark):
    good = {"format": a.FORMAT, "gameId": 1, "perspective": 1,
            "baseSnapshot": {"status": "playing", "turnNumber": 1, "currentPlayer": 1, "myPlayer": {"hand": [], "lore": 0}},
            "frames": [dict(seq=i, actionType=k, player=1, logCountAfter=n, patch=[]) for i, k, n in
                       ((1, "QUEST", 1), (2, "PLAY_CARD", 1), (3, "FREE_UNDO:1", 0), (4, "FREE_UNDO:2", 9))],
            "logs": [{"type": "NOTE"}]}
    text = json.dumps(good).encode()
    rows = [(1, text), (1, gzip.compress(text)), (2, text), (1, b"\xff"), (1, b"[1]"), (1, json.dumps({**good, "perspective": True}).encode())]
    out = a.decode_archives(spark.createDataFrame(rows, "game_id long, content binary")).collect()
    assert sorted((x.encoding, x.error or "") for x in out) == sorted([
        ("identity", ""), ("gzip", ""), ("identity", "wrong_game"), ("identity", "UnicodeDecodeError"),
        ("identity", "not_an_object"), ("identity", "invalid_perspective")])
    body = spark.createDataFrame([(1, text.decode())], "game_id long, body string")
    acts = {x.seq: x for x in a.normalize_actions(a.replay_states(body)).collect()}
    assert [acts[i].undone_by_seq for i in (1, 2, 3, 4)] == [3, 4, 4, None]
    assert acts[3].warnings == ["log_count_decreased"] and acts[4].warnings == ["log_count_clamped"]
    odd = spark.createDataFrame([(1, '{"format":"x"}')], "game_id long, body string")
    assert a.replay_states(odd).first().state_error == "unsupported_format"


def test_undo_matches_brute_force(spark):
    rows = [(1, i, "undo" if i % 5 == 4 else "play", i - 1 - i % 3 if i % 5 == 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "game_id long, seq long, type string, target_seq long")
    got = {x.seq: x.undone_by_seq for x in t.invalidate_ranges(df, 8).collect()}
    for _, s, _, _ in rows:
        cover = [u for _, u, _, target in rows if target is not None and target <= s < u]
        assert got[s] == (max(cover) if cover else None)


def test_mulligan_rules(spark):
    seven = list("abcdefg")
    cases = [(seven, seven, [], [], 0, 0, 2, 0), (seven, seven[3:], seven[:3], list("xyz"), 3, 0, 0, 3),
             (seven, [], seven, list("hijklmn"), 7, 0, 2, 7), (seven, seven[3:], seven[:3], list("xyz"), 3, 1, 2, None),
             (seven, seven[3:], seven[:3], list("xyz"), 3, 0, 3, None), (seven, seven[3:], ["q", "b", "c"], list("xyz"), 3, 0, 2, None),
             (seven, seven, [], [], 8, 0, 2, None), (seven[:6], seven[:6], [], [], 0, 0, 2, None), (seven, seven, None, [], 0, 0, 2, None),
             (["a", "a", *"cdefg"], list("acdefg"), ["a"], ["z"], 1, 0, 2, 1)]
    df = spark.createDataFrame([(i, *x[:7]) for i, x in enumerate(cases)],
                               "i int, h array<string>, k array<string>, s array<string>, d array<string>, n int, w int, p int")
    got = {x.i: x.m for x in df.select("i", t.validated_mulligan(*[F.col(x) for x in "hksdnwp"]).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [x[7] for x in cases]


def test_targets_are_three_valued(spark):
    df = spark.createDataFrame([([("1", "Sail – Sea")],), ([("1", None)],), ([("1", "Other")],), ([],), (None,)],
                               "c array<struct<id:string,name:string>>")
    assert [x[0] for x in df.select(t.target_present(F.col("c"), ["sail - sea"])).collect()] == [True, None, False, False, None]


CAT = """card_id string, name string, collector_number string, ink_colors array<string>, cost int, inkable boolean, card_type string,
 classifications array<string>, rules_text string, strength int, willpower int, lore int, move_cost int"""


def card(i, name, number="1", cost=2):
    return (i, name, number, ["Ruby"], cost, True, "Character", [], "t", 1, 1, 1, None)


def test_resolution(spark):
    cat = spark.createDataFrame([card("1-1", "Piglet – Captain", "12"), card("1-2", "Piglet - Captain", "3"), card("2-1", "Ann"),
                                 card("3-1", "Split", cost=1), card("3-2", "Split", cost=2)], CAT)
    refs = spark.createDataFrame([("2-1", "ANN"), ("2-1", "ann "), ("1-1", "Wrong"), ("9-1", "Ann"), ("9-2", "Piglet  - captain"), ("9-3", "Ann"),
                                  ("9-4", "Gone"), ("9-5", "split"), ("9-6", None), ("1-2", None)], "card_id string, observed_name string")
    alias = spark.createDataFrame([("9-2", "Piglet - Captain"), ("9-3", "Piglet - Captain"), ("9-4", "Gone"), ("9-5", "Split"), ("9-6", "Ann")],
                                  "card_id string, expected_name string")
    got = {x.card_id: (x.status, x.canonical_card_id) for x in c.resolve_entities(refs, cat, alias).collect()}
    assert got == {"2-1": ("exact", "2-1"), "1-1": ("identity_conflict", None), "9-1": ("unresolved", None), "9-2": ("reviewed_alias", "1-2"),
                   "9-3": ("alias_identity_unconfirmed", None), "9-4": ("alias_target_missing", None), "9-5": ("ambiguous_gameplay_data", None),
                   "9-6": ("alias_identity_unconfirmed", None), "1-2": ("exact", "1-2")}


def test_normalized_names(spark):
    df = spark.createDataFrame([("Ａnn’s  — Straße ",), ("plain NAME",), (None,)], "n string")
    assert [x[0] for x in df.select(tx.normalized_name(F.col("n"))).collect()] == ["ann's - strasse", "plain name", None]


def test_deck_fingerprint(spark):
    import hashlib
    df = spark.createDataFrame([(["2-1", " 1-1", "2-1"],), (["1-1", "2-1", "2-1"],), (["1-1", " "],), ([],), (None,)], "d array<string>")
    got = [x[0] for x in df.select(tx.deck_fingerprint("d")).collect()]
    assert got[0] == got[1] == hashlib.sha256(b'[["1-1",1],["2-1",2]]').hexdigest() and got[2:] == [None] * 3


def test_conform(spark):
    rules = [cf.Rule("id", "id"), cf.Rule("at", "at", "timestamp"), cf.Rule("from_", "day", "boundary"), cf.Rule("ok", "ok", "flag", nullable=False),
             cf.Rule("state", "word", "map", mapping=cf.SYNC_STATE)]
    df = spark.createDataFrame([(1, "2026-01-01T00:00:00Z", "2026-01-02", 1, "NOT_ATTEMPTED"), (2, "2026-01-01T00:00:00", "2026-01-02", 0, "SUCCESS"),
                                (3, None, "x", 2, "LOST")], "id int, at string, day string, ok int, word string")
    clean, bad = cf.conform_table(df, rules)
    assert [(x.id, x.ok, x.state) for x in clean.collect()] == [(1, True, "pending")]
    assert {x.id: x.errors for x in bad.collect()} == {2: ["at"], 3: ["from_", "ok", "state"]}


def test_uuid5(spark):
    import uuid
    ns = uuid.NAMESPACE_URL
    df = spark.createDataFrame([("a",), ("é",)], "n string")
    assert [x[0] for x in df.select(tx.uuid5(ns.hex, F.col("n"))).collect()] == [str(uuid.uuid5(ns, n)) for n in ("a", "é")]


def test_weekly_boundary_across_dst(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 11, 1, 13, 59),), (dt.datetime(2026, 11, 1, 14),), (dt.datetime(2026, 3, 10),)], "n timestamp_ntz")
    b = [x[0] for x in df.select(tm.weekly_boundary(F.col("n"))).collect()]
    assert b == [dt.datetime(2026, 10, 25, 13), dt.datetime(2026, 11, 1, 14), dt.datetime(2026, 3, 8, 13)]
    nxt = df.limit(1).select(tm.next_weekly_boundary(tm.weekly_boundary(F.col("n")))).first()[0]
    assert nxt - b[0] == dt.timedelta(hours=169)


def test_current_period(spark):
    s = spark.createDataFrame([("1", "One", "2025-01-01"), ("12", "Two", "2025-06-01"), ("3", "Same", "2025-06-01"), ("Q1", "Promo", "2025-07-01"),
                               ("9", "Later", "2027-01-01"), ("4", None, "2025-08-01"), ("5", "Bad", "soon")], "code string, name string, released_at string")
    x = current_period(s, dt.datetime(2026, 1, 1)).first()
    assert (x.name, x.code) == ("Two", 12)
    assert current_period(s, dt.datetime(2020, 1, 1)).count() == 0


def test_retrieval_matches_brute_force(spark):
    import random
    import re
    rnd = random.Random(5)
    vocab = ["alpha", "bravo", "charlie", "deltas", "echoes", "cards", "short", "foxtrot"]
    pages = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(0, 9)))) for i in range(40)]
    asks = [(i, " ".join(rnd.choices(vocab, k=3)), ["Bravo Charlie"] if i % 2 else []) for i in range(12)] + [(99, "zzz", [])]
    words = lambda s: set(re.findall("[a-z]{5,}", s.lower()))
    want = {}
    for i, text, names in asks:
        scored = sorted((-(len((words(text) - {"cards"}) & words(p)) + 20 * sum(n.lower() in p for n in names)), pid) for pid, p in pages)
        want[i] = [(pid, -s) for s, pid in scored if s][:2]
    for per_pass in (6, 1000):
        out = retrieve_pages(spark.createDataFrame(asks, "request_id long, text string, names array<string>"),
                             spark.createDataFrame(pages, "page_id long, text string").repartition(3), terms_per_pass=per_pass).collect()
        for i, expected in want.items():
            assert [(x.page_id, x.score) for x in sorted(out, key=lambda x: x["rank"]) if x.request_id == i] == expected


def test_select_turns(spark):
    rows = [(1, s, 2, 1 + s % 2, lab, "play") for s, lab in enumerate([1, 1, 4, 4, 5])]
    df = spark.createDataFrame(rows, "game_id long, seq long, active_player int, actor int, turn_label int, type string")
    assert t.action_counts(df, 1).first().own_actions == 3  # replies in the other player's turn
    assert [x.seq for x in t.first_action_per_turn(df, 1).orderBy("seq").collect()] == [0, 2, 4]
    assert sorted(x.seq for x in t.select_turns(df, 1, [4]).collect()) == [2, 3]
    assert sorted(x.seq for x in t.select_turns(df, 1).collect()) == [0, 1]
    assert t.select_turns(df, 1, [4, 9]).count() == 0
    with pytest.raises(ValueError):
        t.select_turns(df, 1, [1, 4, 5])


def test_snapshot_store(spark, tmp_path):
    from matchloom.sources.catalogs import SnapshotStore
    store = SnapshotStore(spark, str(tmp_path / "cards"))
    one = spark.createDataFrame([card("1-1", "A"), card("1-2", "B")], CAT)
    two = spark.createDataFrame([card("1-1", "A"), card("1-2", "C")], CAT)
    assert store.latest() is None
    first, created = store.write(one, "x")
    assert created and store.write(one.repartition(2), "x") == (first, False)
    second, _ = store.write(two, "x")
    assert second != first and {r.name for r in store.latest().collect()} == {"A", "C"}
    assert {r.name for r in store.read(first).collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        store.write(one.unionByName(two), "x")


def test_archive_files(spark, tmp_path):
    (tmp_path / "12.json.gz").write_bytes(gzip.compress(b'{"gameId":12}'))
    (tmp_path / "13.json").write_bytes(b'{"gameId":99}')
    out = {x.game_id: (x.encoding, x.status) for x in a.decode_archives(a.read_archives(spark, str(tmp_path))).collect()}
    assert out == {12: ("gzip", "valid"), 13: ("identity", "invalid")}


def test_text_chunks(spark):
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n" + "c" * 50 + " " + "d" * 10
    df = spark.createDataFrame([(text,), ("short",), ("  ",), (None,)], "t string")
    got = [x[0] for x in df.select(tx.text_chunks(F.col("t"), 50)).collect()]
    assert got == [["a" * 30, "b" * 30, "c" * 50, "d" * 10], ["short"], [], None]


def test_card_ids(spark):
    df = spark.createDataFrame([('{"id":"1-2","x":[{"card_id" : "3-4"},{"target_card_id":"1-2"},{"id":"x"},{"name":"5-6"}]}',)], "b string")
    assert df.select(tx.card_ids(F.col("b"))).first()[0] == ["1-2", "3-4"]


def test_scratch_can_be_dropped(spark):
    import os

    from matchloom import session as ss
    path = ss.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    parent = os.path.dirname(path)
    assert ss.path_exists(spark, path) and parent.endswith(spark.sparkContext.applicationId)
    ss.remove_path(spark, path)
    assert not ss.path_exists(spark, path)


def test_snapshot_hash_covers_arrays(spark, tmp_path):
    from matchloom.sources.catalogs import SnapshotStore
    store = SnapshotStore(spark, str(tmp_path / "arrays"))
    frame = lambda ink: spark.sql(f"select 'a' card_id, 'A' name, array('{ink}') ink_colors")
    first, second, again = (store.write(frame(x), "test") for x in ("Ruby", "Steel", "Ruby"))
    assert first[1] and second[1] and not again[1] and first[0] == again[0] != second[0]


def test_patch_path_needs_a_leading_slash():
    from matchloom.sources.archives import set_path
    with pytest.raises(ValueError, match="leading slash"):
        set_path({"a": 1}, "replace", "a", 2)


def test_folded_keys_and_titles(spark):
    from matchloom.functions.labels import colors_label
    row = spark.sql("select 'STRAßE  Σς' k, array('ruby-steel') c").select(tx.card_key(F.col("k")), colors_label("c")).first()
    assert tuple(row) == ("strasse σσ", "Ruby-Steel")


def test_follow_up_stops_at_a_frame_that_answers_nothing(spark):
    import json
    from matchloom.sources import archives as a
    ability = {"type": "ABILITY_ACTIVATED", "message": "Ann activated Glow on Lamp", "cardRefs": [{"id": "8-1", "name": "Lamp"}]}

    def game(game_id, kinds, log_at):
        frames = [{"seq": i, "player": 1, "actionType": k, "logCountAfter": i + 1, "patch": []} for i, k in enumerate(kinds)]
        logs = [ability if i == log_at else {"type": "NOTE"} for i in range(len(kinds))]
        return game_id, json.dumps({"format": a.FORMAT, "perspective": 1, "frames": frames, "logs": logs})
    reply, act = "RESPOND_TO_PROMPT", "ACTIVATE_ABILITY"
    rows = [game(1, [act, reply, reply, reply, reply], 3), game(2, [act, reply, reply, reply, reply], 4),
            game(3, [act, reply, "QUEST", reply], 3), game(4, [act], 9), game(5, [act, act, reply], 2),
            (6, json.dumps({"format": a.FORMAT, "frames": []}))]
    docs = spark.createDataFrame(rows, "game_id long, body string")
    got = a.normalize_actions(a.replay_states(docs)).filter("type = 'activate_ability'").select(
        "game_id", "seq", "card_name", "derived_from_followup_seq", "game_warnings").orderBy("game_id", "seq").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Lamp", 3, 1), (2, 0, None, None, 1), (3, 0, None, None, 1), (4, 0, None, None, 1),
                                       (5, 0, None, None, 1), (5, 1, "Lamp", 2, 1)]
    assert [r.warnings for r in a.normalize_games(a.replay_states(docs)).collect()] == [["no_starting_player"]] * 6


def test_board_is_read_again_after_a_patch(spark):
    import json
    from matchloom.sources import archives as a
    frames = [
        {"seq": 0, "player": 1, "actionType": "QUEST", "patch": [{"op": "replace", "path": "/myPlayer/field/0/damage", "value": 2}]},
        {"seq": 1, "player": 1, "actionType": "QUEST", "patch": [{"op": "replace", "path": "/myPlayer", "value": {"hand": [{"id": "1-1"}]}}]},
        {"seq": 2, "player": 2, "actionType": "QUEST", "patch": []}, {"seq": 3, "player": 1, "actionType": "QUEST", "patch": []}]
    body = {"format": a.FORMAT, "perspective": 1, "frames": frames, "logs": [],
            "baseSnapshot": {"myPlayer": {"field": [{"id": "3-1", "instanceId": "a", "cardsUnder": [1, 2]}], "inkwell": [
                {"exerted": False, "card": {"id": "i"}}, {"card": {"exerted": True}}, "odd"]}}}
    rows = a.normalize_actions(a.replay_states(spark.createDataFrame([(1, json.dumps(body))], "game_id long, body string")))
    got = rows.orderBy("seq").collect()
    assert [(c.damage, c.cards_under) for r in got[:2] for c in r.board.field] == [(None, 2), (2, 2)]
    assert got[0].ink_count == 2 and got[0].ready_ink == 1 and got[2].board is None
    assert got[3].board.field == [] and [c.id for c in got[3].hand] == ["1-1"]


def test_pages_and_requests_meet_in_blocks_of_any_size(spark):
    from matchloom.plans.retrieval import retrieve_pages
    pages = [(i, f"common words Page{i % 7} {'special treasure' if i % 3 == 0 else 'plain'} number{i}") for i in range(60)]
    asks = [(i, f"common treasure number{i}", [f"Page{i % 7}", ""]) for i in range(25)] + [(99, "nothing fits", ["Absent"])]
    p = spark.createDataFrame(pages, "page_id long, text string")
    r = spark.createDataFrame(asks, "request_id long, text string, names array<string>")
    want = {}
    for rid, text, names in asks:
        found = lambda t: set(re.findall("[a-z]{5,}", t.lower()))
        scored = sorted((-(len(found(text) & found(t)) + 20 * sum(
            n.lower() in t.lower() for n in names if n)), pid) for pid, t in pages)
        want[rid] = [(pid, -s) for s, pid in scored[:3] if s]
    for kw in ({}, {"terms_per_pass": 7, "block_bytes": 100}):
        got = {}
        for row in retrieve_pages(r, p, 3, **kw).orderBy("request_id", "rank").collect():
            got.setdefault(row.request_id, []).append((row.page_id, row.score))
        assert got == {k: v for k, v in want.items() if v}
    empty = spark.createDataFrame([], p.schema)
    assert retrieve_pages(r, empty).collect() == [] and retrieve_pages(spark.createDataFrame([], r.schema), p).collect() == []


def test_folded_states_leave_a_few_games_at_a_time():
    import pyarrow as pa
    bodies = [json.dumps({"format": a.FORMAT, "frames": [{"seq": i}]}) for i in range(1000)] + [None, "{}"]
    batch = pa.RecordBatch.from_pydict({"game_id": list(range(len(bodies))), "body": bodies})
    out = list(a._folded([batch]))
    assert max(b.num_rows for b in out) <= a.GAMES_AT_ONCE < 1000
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["game_id"], r["body"]) for r in rows] == list(enumerate(bodies))
    assert [r["state_error"] for r in rows[-3:]] == [None, "patch_failed: TypeError", "unsupported_format"]


def test_text_chunks_of_more_rows_than_are_cut_at_once(spark):
    texts = [None if i % 7 == 0 else ("word " * (i % 40)).strip() for i in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for r in df.select("t", tx.text_chunks(F.col("t"), 50).alias("c")).collect():
        assert r.c == r.t if r.t is None else " ".join(r.c) == r.t and all(len(x) <= 50 for x in r.c)


def test_page_scores_of_a_block_are_held_a_few_pages_at_a_time():
    import random
    import tracemalloc

    import pandas as pd
    from matchloom.plans import retrieval
    rnd = random.Random(3)
    asked = [rnd.sample([f"w{i}" for i in range(40)], 4) for _ in range(3000)]
    index = retrieval._Index(pd.DataFrame({"request_id": range(3000), "terms": asked, "names": [[]] * 3000}))
    held = [rnd.sample([f"w{i}" for i in range(60)], 5) for _ in range(2000)]
    numbers = rnd.sample(range(10_000), 2000)
    tracemalloc.start()
    found = retrieval._best(index, pd.DataFrame({"page_id": numbers, "text": "", "words": held}), 2)
    found = found if isinstance(found, pd.DataFrame) else pd.concat(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    got = found.sort_values(["request_id", "score", "page_id"], ascending=[True, False, True]).groupby("request_id").head(2)
    for i in range(0, 3000, 271):
        want = sorted((-len(set(asked[i]) & set(w)), p) for p, w in zip(numbers, held) if set(asked[i]) & set(w))[:2]
        assert [(-r.score, r.page_id) for r in got[got["request_id"] == i].itertuples()] == want
