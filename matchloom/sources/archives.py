"""Replay archives: bytes to JSON, state folding per archive, and the action table.

An archive is one file and one row, so everything about a game happens inside its row:
Python replays the state patches, and Spark expressions do the rest on the row's own arrays.
Nothing is shuffled until the actions are exploded for reports.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Collection, Iterator
from functools import partial
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import spread

# Archive format, parser version and the names of action types.
FORMAT = "duels-replay-v1"
PARSER_VERSION = "parser_v1"
GAMES_AT_ONCE, BYTES_AT_ONCE = 512, 2 << 20  # archives, and their text, that are folded before their states are handed on
ACTION_TYPES = {
    "CHOOSE_STARTING_PLAYER": "choose_starting_player",
    "MULLIGAN": "mulligan",
    "ADD_TO_INK": "ink",
    "PLAY_CARD": "play",
    "QUEST": "quest",
    "ATTACK": "challenge",
    "ACTIVATE_ABILITY": "activate_ability",
    "BOOST": "boost",
    "RESPOND_TO_PROMPT": "choice",
    "END_TURN": "end_turn",
    "CONCEDE": "concede",
    "GAME_FINISH": "game_finish",
}

REF = "struct<id:string,name:string>"
# What a challenge log records, under the names the action table uses.
COMBAT = {
    "attacker_base_strength": "attackerBaseStrength",
    "attacker_challenger_bonus": "attackerChallengerBonus",
    "raw_damage_to_defender": "rawDamageToDefender",
    "actual_damage_to_defender": "actualDamageToDefender",
    "defender_resist_reduction": "defenderResistReduction",
    "defender_willpower": "defenderWillpower",
    "defender_total_damage": "defenderTotalDamage",
    "raw_damage_to_attacker": "rawDamageToAttacker",
    "actual_damage_to_attacker": "actualDamageToAttacker",
    "attacker_resist_reduction": "attackerResistReduction",
    "attacker_willpower": "attackerWillpower",
    "attacker_total_damage": "attackerTotalDamage",
}
BODY = f"""format string, gameId string, createdAt string, perspective int, winner int, victoryReason string, turnCount int,
 fromPlayground boolean, playerNames map<string,string>, decklist array<string>,
 frames array<struct<seq:long,actionType:string,player:int,turnNumber:int,logCountAfter:int,
  takenAction:struct<cardId:string,cardInstanceId:string,cardName:string,cardType:string,source:string,
   abilityName:string,loreGained:int,newLoreTotal:int,attackerCardId:string,attackerInstanceId:string,
   attackerName:string,defenderCardId:string,defenderInstanceId:string,defenderName:string,
   damageToDefender:int,damageToAttacker:int,defenderBanished:boolean,attackerBanished:boolean>>>,
 logs array<struct<id:string,type:string,player:int,turnNumber:int,message:string,cardRefs:array<{REF}>,
  data:struct<mulliganCount:int,{",".join(f"{name}:int" for name in COMBAT.values())}>>>"""

# Names of a card's facts in the archive, around its name, in the order of CARD.
CARD_FACTS = ("id", "instanceId"), ("type", "colors", "cost", "inkable", "strength", "willpower", "lore", "damage", "exerted",
                                    "justPlayed")
INSTANCE = 1  # where a card's facts have its instance
CARD = ("struct<id:string,instance_id:string,name:string,type:string,colors:array<string>,cost:int,inkable:boolean,"
        "strength:int,willpower:int,lore:int,damage:int,exerted:boolean,just_played:boolean,cards_under:int>")
PLACED = f"struct<owner:string,zone:string,card:{CARD}>"
INK = f"struct<hidden:boolean,exerted:boolean,card:{CARD}>"
PROMPT = (f"struct<source_card:{CARD},opponent_pending:boolean,prompts:array<struct<id:string,type:string,message:string,"
          "required:boolean,min_select:int,max_select:int,valid_targets:string,source_card_instance_id:string,"
          "source_ability:string,params:string>>>")
ZONES = ",".join(f"{who}{zone}:array<{CARD}>" for who in ("", "opponent_") for zone in ("field", "items", "discard"))
STATE = f"""struct<status:string,turn_number:int,current_player:int,first_player:int,has_inked:boolean,
 lore:int,hand_count:int,deck_count:int,ink_count:int,ready_ink:int,opponent_lore:int,opponent_hand_count:int,
 opponent_deck_count:int,opponent_ink_count:int,opponent_ready_ink:int,hand:array<{CARD}>,{ZONES},inkwell:array<{INK}>,
 opponent_inkwell:array<{INK}>,hand_after:array<{CARD}>,attacker_before:{PLACED},attacker_after:{PLACED},
 defender_before:{PLACED},defender_after:{PLACED},prompt:{PROMPT},first_log:int,end_log:int,warning:string>"""
GAME = (f"struct<replay_id:string,starting_hand:array<{CARD}>,winner:int,first_player:int,warnings:array<string>,"
        f"final_state:{STATE}>")


def _arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a plain DDL type, an array or a struct."""
    ddl = ddl.strip()
    if ddl.startswith("array<"):
        return pa.list_(_arrow_type(ddl[6:-1]))
    if not ddl.startswith("struct<"):
        return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[ddl]
    fields, depth = [""], 0
    for c in ddl[7:-1]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append("")
        else:
            fields[-1] += c
    return pa.struct([(name.strip(), _arrow_type(kind)) for name, kind in (f.split(":", 1) for f in fields)])


PLAIN = {pa.string().id: {str, type(None)}, pa.int32().id: {int, type(None)}, pa.bool_().id: {bool, type(None)}}
STATE_TYPE, GAME_TYPE = _arrow_type(STATE), _arrow_type(GAME)
HAND = STATE_TYPE.get_field_index("hand") - 4  # behind ``has_inked``
NO_ZONES = (None,) * 9
BOARD = ("field", "items", "inkwell", "discard")
# What a caller may leave out: most of a state's text is cards that are written again for every frame.
CARD_FIELDS = frozenset((
    "hand", *(who + zone for who in ("", "opponent_") for zone in ("field", "items", "discard", "inkwell")), "hand_after",
    "attacker_before", "attacker_after", "defender_before", "defender_after", "prompt", "starting_hand", "final_state"))


# --- bytes -------------------------------------------------------------------------------

def _open(content: bytes, expected) -> tuple[str, str | None, str | None]:
    packed = content[:2] == b"\x1f\x8b"
    encoding = "gzip" if packed else "identity"
    try:
        value = (gzip.decompress(content) if packed else content).decode("utf-8")
        body = json.loads(value)
    except Exception as error:  # whatever is wrong with the bytes, the row says so
        return encoding, None, f"{type(error).__name__}"
    if not isinstance(body, dict):
        return encoding, None, "not_an_object"
    if str(body.get("gameId")) != str(expected):
        return encoding, None, "wrong_game"
    seat = body.get("perspective")
    if seat is not None and (isinstance(seat, bool) or not isinstance(seat, int)):
        return encoding, None, "invalid_perspective"
    return encoding, value, None


def read_archives(spark, path: str) -> DataFrame:
    """Archive files named ``<game id>.<anything>`` as (game_id, content)."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.split(name, r"\.").getItem(0).cast("long").alias("game_id"), "content")


def decode_archives(files: DataFrame) -> DataFrame:
    """(game_id, content) to text; bad archives stay with status ``invalid`` and a reason."""
    def run(batches):
        for frame in batches:
            rows = [_open(bytes(c), g) for c, g in zip(frame["content"], frame["game_id"])]
            yield pd.DataFrame({
                "game_id": frame["game_id"], "sha256": frame["sha256"],
                "encoding": [r[0] for r in rows], "body": [r[1] for r in rows],
                "error": [r[2] for r in rows]})
    hashed = spread(files.select("game_id", "content"), "game_id").withColumn(
        "sha256", F.sha2("content", 256))
    out = hashed.mapInPandas(
        run, "game_id long, sha256 string, encoding string, body string, error string")
    return out.withColumn("status", F.when(F.col("error").isNull(), "valid").otherwise("invalid"))


# --- state -------------------------------------------------------------------------------

def set_path(state, op: str, path: str, value):
    """Apply one patch: replace sets, a missing removal is ignored, gaps in lists fail."""
    if op not in ("add", "remove", "replace"):
        raise ValueError(f"unsupported operation {op!r}")
    if path == "":
        return None if op == "remove" else value
    if not path.startswith("/"):
        raise ValueError(f"patch path without a leading slash: {path!r}")
    names = path[1:].split("/")
    *parents, last = [p.replace("~1", "/").replace("~0", "~") for p in names] if "~" in path else names
    node = state
    for name in parents:
        if isinstance(node, dict):
            if name not in node:
                if op == "remove":
                    raise KeyError(path)
                node[name] = {}
            node = node[name]
        else:
            at = int(name)
            if not 0 <= at < len(node):
                raise IndexError(path)
            node = node[at]
    if isinstance(node, dict):
        if op == "remove":
            node.pop(last, None)
        else:
            node[last] = value
        return state
    at = len(node) if last == "-" else int(last)
    if op == "remove":
        if 0 <= at < len(node):
            del node[at]
    elif not 0 <= at <= len(node) or (op == "replace" and last == "-"):
        raise IndexError(path)
    elif op == "add" or at == len(node):
        node.insert(at, value)
    else:
        node[at] = value
    return state


def _card(card: dict) -> tuple:
    """Facts of a card in the order of CARD."""
    own, more = CARD_FACTS
    return (*map(card.get, own), card.get("fullName") or card.get("name"), *map(card.get, more), len(card.get("cardsUnder") or []))


class _Table:
    """What a player sees of the state; a zone is read again only after a patch touched it, a card after one inside a card.

    Cards, states and all they are made of are tuples in the order of their types.
    """

    def __init__(self, state):
        self.state, self.seen, self.cards = state, {}, {}

    def patch(self, op, path, value) -> None:
        self.state = set_path(self.state, op, path, value)
        steps = path.split("/")
        if len(steps) < 3:
            self.seen.clear()
        else:  # what is read of the zone, and of its player's counts and zones
            self.seen.pop((steps[1], steps[2]), None)
            self.seen.pop((steps[1], ""), None)
            if steps[2] in BOARD:
                self.seen.pop((steps[1], None), None)
        if len(steps) > 4:  # four steps name an entry of a zone
            self.cards.clear()

    def card(self, card: dict) -> tuple:
        known = self.cards.get(id(card))
        if known is None:  # the card is kept beside its facts, so no other takes its id
            known = self.cards[id(card)] = card, _card(card)
        return known[1]

    def player(self, who: str) -> dict:
        return self.state.get(who) or {}

    def zone(self, who: str, zone: str) -> list[tuple]:
        known = self.seen.get((who, zone))
        if known is None:
            cards = [c for c in self.player(who).get(zone) or [] if isinstance(c, dict)]
            if zone == "inkwell":
                cards = [(c.get("hidden"), c.get("exerted", (c.get("card") or {}).get("exerted")),
                          self.card(c["card"]) if isinstance(c.get("card"), dict) else None) for c in cards]
            else:
                cards = [self.card(c) for c in cards]
            known = self.seen[who, zone] = cards
        return known

    def counts(self, who: str) -> tuple:
        """Lore, cards in hand and deck, ink and ready ink."""
        known = self.seen.get((who, ""))
        if known is None:
            ink, player = self.zone(who, "inkwell"), self.player(who)
            hand = len(player.get("hand") or []) if who == "myPlayer" else player.get("handCount")
            known = self.seen[who, ""] = (
                player.get("lore"), hand, player.get("deckCount"), len(ink), sum([e[1] is False for e in ink]))
        return known

    def zones(self, who: str) -> tuple:
        """Field, items, discard, and apart from them the inkwell."""
        known = self.seen.get((who, None))
        if known is None:
            field, items, ink, discard = [self.zone(who, z) for z in BOARD]
            known = self.seen[who, None] = (field, items, discard), (ink,)
        return known

    def facts(self, zones: bool) -> tuple[tuple, tuple]:
        """A state up to its current player, and from ``has_inked`` to the zones; an opponent's frame never shows the hand."""
        state = self.state
        turn, inked = (state.get("status"), state.get("turnNumber"), state.get("currentPlayer")), state.get("hasInkedThisTurn")
        mine, theirs = self.counts("myPlayer"), self.counts("opponent")
        if not zones:
            return turn, (inked, *mine, *theirs, *NO_ZONES)
        (own, ink), (other, other_ink) = self.zones("myPlayer"), self.zones("opponent")
        return turn, (inked, *mine, *theirs, self.zone("myPlayer", "hand"), *own, *other, *ink, *other_ink)

    def placed(self, instance: str | None) -> tuple | None:
        """Where a card lies; a challenge may have moved it."""
        if instance:
            for who, owner in (("myPlayer", "perspective"), ("opponent", "opponent")):
                for zone in ("field", "items", "hand", "discard", "inkwell"):
                    for c in self.zone(who, zone):
                        card = c[2] if zone == "inkwell" else c
                        if card and card[INSTANCE] == instance:
                            return owner, zone, card
        return None

    def prompt(self, visible: bool) -> tuple:
        source, text = self.state.get("promptSourceCard"), lambda v: None if v is None else json.dumps(v)
        return (_card(source) if isinstance(source, dict) else None, self.state.get("opponentHasPendingPrompts"),
                [(p.get("id"), p.get("type"), p.get("message"), p.get("required"), p.get("minSelect"), p.get("maxSelect"),
                  text(p.get("validTargets")), p.get("sourceCardInstanceId"), p.get("sourceAbility"), text(p.get("params")))
                 for p in self.state.get("pendingPrompts") or [] if visible and isinstance(p, dict)])


def _fold(body: dict) -> tuple[list[tuple], tuple]:
    """States before each frame, and what only the whole game tells (its warnings among it)."""
    table, logs = _Table(body.get("baseSnapshot") or {}), body.get("logs") or []
    seen, states, warnings = body.get("baseSnapshotLogCount") or 0, [], []
    seat, chosen = body.get("perspective"), False
    replay_id, starting_hand = table.state.get("replayId"), table.zone("myPlayer", "hand")
    logged = next((log.get("data") or {} for log in logs if log.get("type") == "MULLIGAN" and log.get("player") == seat), {})
    logged = logged.get("mulliganCount")
    for frame in body.get("frames") or []:
        kind, taken, count = frame.get("actionType"), frame.get("takenAction") or {}, frame.get("logCountAfter")
        own, attack = frame.get("player") == seat, kind == "ATTACK"
        turn, board = table.facts(own)
        hand_after = prompt = warning = None
        before = after = (None, None)
        if attack:
            sides = [taken.get(f"{s}InstanceId") for s in ("attacker", "defender")]
            before = [table.placed(i) for i in sides]
        if kind == "RESPOND_TO_PROMPT":
            prompt = table.prompt(own)
        first_log = end_log = seen
        if isinstance(count, int):
            if count < seen:
                warning, seen = "log_count_decreased", count
            else:
                warning = "log_count_clamped" if count > len(logs) else None
                end_log = seen = min(count, len(logs))
        if warning:
            warnings.append(warning)
        for p in frame.get("patch") or []:
            table.patch(p.get("op"), p.get("path"), p.get("value"))
        if attack:
            after = [table.placed(i) for i in sides]
        if own and kind == "MULLIGAN":
            hand, hand_after = board[HAND], table.zone("myPlayer", "hand")
            held = {c[INSTANCE] for c in hand if c[INSTANCE]}
            sent = held - {c[INSTANCE] for c in hand_after}
            if type(logged) is int and logged != len(sent):
                warnings.append("mulligan_count_differs")
        chosen = chosen or kind == "CHOOSE_STARTING_PLAYER"
        states.append((*turn, table.state.get("firstPlayer"), *board, hand_after, before[0], after[0], before[1], after[1], prompt,
                       first_log, end_log, warning))
    winner = table.state.get("winner")
    if not chosen:
        warnings.append("no_starting_player")
    if winner is not None and body.get("winner") is not None and winner != body["winner"]:
        warnings.append("winner_differs")
    turn, board = table.facts(True)
    return states, (replay_id, starting_hand, winner, table.state.get("firstPlayer"), warnings,
                    (*turn, None, *board, *[None] * (len(STATE_TYPE) - len(board) - 4)))


def _fold_text(text: str | None) -> tuple[tuple | None, str | None]:
    try:
        body = json.loads(text)
        if body.get("format") != FORMAT:
            return None, "unsupported_format"
        return _fold(body), None
    except Exception as error:
        return None, f"patch_failed: {type(error).__name__}"


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """``values`` as an Arrow array; a TypeError if one is of another type.

    What occurs often, as a card or a zone that no patch touched, is converted once.
    """
    if kind.id in PLAIN:
        if not set(map(type, values)) <= PLAIN[kind.id]:
            raise TypeError(f"not only {kind}")
        return pa.array(values, kind)
    ids = list(map(id, values))
    distinct = dict(zip(ids, values))
    if 2 * len(distinct) < len(ids):
        place = dict(zip(distinct, range(len(distinct))))
        return _array(list(distinct.values()), kind).take(pa.array(map(place.__getitem__, ids), pa.int32()))
    none = [v is None for v in values]
    if pa.types.is_struct(kind):
        return _structs(values, kind, none)
    if not set(map(type, values)) <= {list, type(None)}:
        raise TypeError("not only lists")
    held = [v or () for v in values]
    return pa.ListArray.from_arrays(
        pa.array(accumulate(map(len, held), initial=0), pa.int32()), _array(list(chain.from_iterable(held)), kind.value_type),
        kind, mask=pa.array(none, pa.bool_()) if any(none) else None)


def _structs(rows: list[tuple | None], kind: pa.StructType, none: list[bool], left_out: Collection[str] = ()) -> pa.Array:
    """Rows as an Arrow array of structs; fields that are left out are null."""
    empty = (None,) * len(kind)
    columns = list(zip(*[empty if r is None else r for r in rows])) or [()] * len(kind)
    return pa.StructArray.from_arrays(
        [pa.nulls(len(rows), f.type) if f.name in left_out else _array(c, f.type) for c, f in zip(columns, kind)],
        fields=list(kind), mask=pa.array(none, pa.bool_()) if any(none) else None)


def _typed(folded: list[tuple | None], left_out: Collection[str]) -> tuple[pa.Array, pa.Array]:
    """States and games of some archives; a TypeError or ArrowException if a value is not of its field's type."""
    states, none = [f[0] if f else () for f in folded], [f is None for f in folded]
    rows = list(chain.from_iterable(states))
    lists = pa.ListArray.from_arrays(
        pa.array(accumulate(map(len, states), initial=0), pa.int32()), _structs(rows, STATE_TYPE, [False], left_out),
        mask=pa.array(none, pa.bool_()))
    return lists, _structs([f[1] if f else None for f in folded], GAME_TYPE, none, left_out)


def _as_text(folded: tuple | None, left_out: Collection[str]) -> str | None:
    """The same as JSON, which is read field by field."""
    def named(value, kind):
        if value is None or kind.id in PLAIN:
            return value
        if pa.types.is_list(kind):
            return [named(v, kind.value_type) for v in value] if isinstance(value, list) else value
        return {f.name: named(v, f.type) for v, f in zip(value, kind) if v is not None}

    if folded is None:
        return None
    kept = lambda row, kind: {k: v for k, v in named(row, kind).items() if k not in left_out}
    return json.dumps({"states": [kept(x, STATE_TYPE) for x in folded[0]], "game": kept(folded[1], GAME_TYPE)})


def _portions(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut after ``GAMES_AT_ONCE`` or before a body that exceeds ``BYTES_AT_ONCE``, but for a single one."""
    first, held = 0, 0
    for at, size in enumerate(pc.binary_length(whole.column("body")).to_pylist()):
        held += size or 0
        if at > first and (at - first == GAMES_AT_ONCE or held > BYTES_AT_ONCE):
            yield whole.slice(first, at - first)
            first, held = at, size or 0
    if first < whole.num_rows:
        yield whole.slice(first)


def _folded(batches: Iterator[pa.RecordBatch], left_out: Collection[str] = ()) -> Iterator[pa.RecordBatch]:
    """Batches with their folded states, handed on a few games at a time as they are many times the bodies.

    States have the types of their fields. Games among which a value has another type are handed on as text.
    """
    for whole in batches:
        for batch in _portions(whole):
            rows = [_fold_text(t) for t in batch.column("body").to_pylist()]
            folded, n = [r[0] for r in rows], len(rows)
            try:
                states, games = _typed(folded, left_out)
                text = pa.nulls(n, pa.string())
            except (TypeError, UnicodeError, OverflowError, pa.ArrowException):
                states, games = pa.nulls(n, pa.list_(STATE_TYPE)), pa.nulls(n, GAME_TYPE)
                text = pa.array([_as_text(f, left_out) for f in folded], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("game_id"), batch.column("body"), states, games, text, pa.array([r[1] for r in rows], pa.string())],
                names=["game_id", "body", "states", "game", "folded", "state_error"])


def replay_states(archives: DataFrame, cards: Collection[str] | None = None) -> DataFrame:
    """Add ``states``, what the game looked like before each frame, and ``game``, what only the whole game tells.

    ``state_error`` is set when the format is unknown or a patch cannot be applied. Bodies stay in the tasks they come
    in: spread few files before they are read into bodies, not after. Every patch is folded in any case; ``cards`` names
    those ``CARD_FIELDS`` that are handed on (None: all), the others are null.
    """
    left_out = frozenset() if cards is None else CARD_FIELDS - frozenset(cards)

    out = archives.select("game_id", "body").mapInArrow(
        partial(_folded, left_out=left_out),
        f"game_id long, body string, states array<{STATE}>, game {GAME}, folded string, state_error string")
    return out.withColumn("_f", F.from_json("folded", f"states array<{STATE}>, game {GAME}")).select(
        "game_id", "body", F.coalesce("states", "_f.states").alias("states"), F.coalesce("game", "_f.game").alias("game"),
        "state_error")


# --- actions -----------------------------------------------------------------------------

def _log(logs: Column, kind: str) -> Column:
    return F.get(F.filter(logs, lambda log: log["type"] == kind), F.lit(0))


def _ref(log: Column, i: int = 0) -> Column:
    return F.get(log["cardRefs"], F.lit(i))


def _ability(log: Column) -> Column:
    return _filled(F.trim(F.regexp_extract(log["message"], r"(?i)\bactivated\s+(.+?)\s+on\s+", 1)))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _parsed(states: DataFrame) -> DataFrame:
    """One row per game: body ``b``, ``game``, ``undos`` and ``framed``, its frames with state, logs and what follows.

    Logs are cut out for each frame while the game is one row. ``next`` holds, for the three
    frames that follow, whether they answer a prompt and the ability their logs name.
    """
    undo_of = lambda f: F.regexp_extract(f["actionType"], r"^FREE_UNDO:(\d+)$", 1)
    rows = states.filter(F.col("state_error").isNull()).select(
        "game_id", F.from_json("body", BODY).alias("b"), "states", "game")
    is_undo = lambda f: f["actionType"].startswith("FREE_UNDO:") & (undo_of(f) != "")
    rows = rows.withColumn("undos", F.transform(F.filter("b.frames", is_undo), lambda f: F.struct(
        f["seq"].alias("at"), undo_of(f).cast("long").alias("target"))))
    zipped = F.arrays_zip(F.col("b.frames").alias("f"), F.col("states").alias("s"))
    rows = rows.withColumn("zipped", F.transform(zipped, lambda z: F.struct(
        z["f"].alias("f"), z["s"].alias("s"), F.coalesce(F.slice(
            "b.logs", z["s"]["first_log"] + 1, z["s"]["end_log"] - z["s"]["first_log"]), F.array()).alias("logs"))))
    look = F.transform("zipped", lambda z: F.struct(
        z["f"]["seq"].alias("seq"), (z["f"]["actionType"] == "RESPOND_TO_PROMPT").alias("reply"),
        _log(z["logs"], "ABILITY_ACTIVATED").alias("log")))
    look = F.transform(look, lambda n: F.struct(
        n["seq"], n["reply"], n["log"].isNotNull().alias("names"), _ability(n["log"]).alias("ability"),
        _ref(n["log"])["id"].alias("id"), _ref(n["log"])["name"].alias("name")))
    rows = rows.withColumn("look", look)
    return rows.withColumn("framed", F.arrays_zip(
        F.col("zipped").alias("z"), *[F.slice("look", i + 1, F.size("look")).alias(f"n{i}") for i in (1, 2, 3)]))


def _first_player() -> Column:
    chosen = F.filter("zipped", lambda z: z["f"]["actionType"] == "CHOOSE_STARTING_PLAYER")
    return F.coalesce(F.get(chosen, F.size(chosen) - 1)["s"]["first_player"], F.col("game.first_player"))


def _player(names: Column, player: Column) -> Column:
    return F.when(player.isNotNull(), F.coalesce(
        _filled(F.element_at(names, player.cast("string"))), F.concat(F.lit("Player "), player.cast("string"))))


def normalize_games(states: DataFrame) -> DataFrame:
    """One row per game: who played, who won, opening hand, logged mulligan, undos, last state, warnings."""
    log = F.get(F.filter("b.logs", lambda x: (x["type"] == "MULLIGAN") & (x["player"] == F.col("b.perspective"))), F.lit(0))
    count = F.col("_log.data.mulliganCount")
    rows = _parsed(states).withColumn("_log", log)
    cards = lambda first: F.coalesce(F.slice("_log.cardRefs", first, F.greatest(count, F.lit(0))), F.array())
    return rows.select(
        "game_id", "game.replay_id", F.col("b.createdAt").alias("created_at"), "b.perspective",
        _player(F.col("b.playerNames"), F.col("b.perspective")).alias("perspective_name"),
        F.col("b.playerNames").alias("player_names"), _first_player().alias("first_player"), "b.winner",
        F.col("b.victoryReason").alias("victory_reason"), F.col("b.turnCount").alias("turn_count"),
        F.col("b.fromPlayground").alias("from_playground"), "game.starting_hand",
        F.coalesce("b.decklist", F.array()).alias("decklist"),
        F.when(count.isNotNull(), F.struct(count.alias("count"), cards(F.lit(1)).alias("sent_back"),
                                           cards(F.greatest(count, F.lit(0)) + 1).alias("drawn"))).alias("mulligan_log"),
        F.transform("undos", lambda u: F.struct(u["at"].alias("undo_seq"), u["target"].alias("target_seq"),
                                                (u["at"] - 1).alias("invalidated_through_seq"))).alias("undo_ranges"),
        "game.final_state", "game.warnings")


def normalize_actions(states: DataFrame) -> DataFrame:
    """One row per frame with type, actor, turn, card, outcome, board, prompt, choices, undo and mulligan facts.

    Turn and active player come from the state before the frame. Missing card facts are inferred from the frame's logs;
    an ability without a card takes it from the next three frames, as long as they answer prompts. ``undone`` uses the
    row's own undo frames. ``segment_player`` also knows the active player of own undo frames, which border turns.
    A game with any warning, wherever in the game it arises, has no eligible opening.
    """
    b = _parsed(states)
    covers = lambda seq: lambda u: (u["target"] <= seq) & (seq < u["at"])
    opened = F.exists("b.frames", lambda f: (f["actionType"] == "MULLIGAN") & f["player"].eqNullSafe(F.col("b.perspective"))
                      & ~F.exists("undos", covers(f["seq"])))
    seats = F.coalesce(F.size("b.playerNames"), F.lit(0)).isin(-1, 0, 2)
    b = b.select(
        "game_id", F.col("b.perspective").alias("perspective"), "undos", F.col("b.playerNames").alias("names"),
        _first_player().alias("game_first_player"), F.size("game.warnings").alias("game_warnings"),
        ((F.size("game.warnings") == 0) & seats & F.col("b.perspective").isNotNull() & opened).alias("opening_eligible"),
        # the outer form: a plain explode would first filter on the array's size and so parse every body twice
        F.posexplode_outer("framed").alias("pos", "x")).filter(F.col("pos").isNotNull())
    rows = b.select("game_id", "pos", "perspective", "undos", "names", "game_first_player", "game_warnings",
                    "opening_eligible", "x.z.f.*", F.col("x.z.s").alias("s"), F.col("x.z.logs").alias("frame_logs"),
                    *[f"x.n{i}" for i in (1, 2, 3)])
    raw, taken = F.coalesce("actionType", F.lit("UNKNOWN")), F.col("takenAction")
    kind = F.lower(raw)
    for name, plain in ACTION_TYPES.items():
        kind = F.when(raw == name, plain).otherwise(kind)
    undo_target = F.when(raw.startswith("FREE_UNDO:"), F.regexp_extract(raw, r"^FREE_UNDO:(\d+)$", 1)).otherwise("")
    is_undo = undo_target != ""
    playing = F.col("s.status").eqNullSafe(F.lit("playing"))
    rows = rows.withColumns({name: F.when(raw == action, _log(F.col("frame_logs"), log)) for name, action, log in (
        ("_played", "PLAY_CARD", "CARD_PLAYED"), ("_boosted", "BOOST", "CARD_BOOSTED"),
        ("_ability", "ACTIVATE_ABILITY", "ABILITY_ACTIVATED"))})
    played, ability = F.col("_played"), F.col("_ability")
    attack, activates = raw == "ATTACK", raw == "ACTIVATE_ABILITY"
    named = F.coalesce(taken["cardName"], F.lit("")) != ""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    source_log = F.when((raw == "PLAY_CARD") & ~named, _ref(played)).when(
        (raw == "BOOST") & ~named, _ref(F.col("_boosted"))).when(activates, _ref(ability))
    # the first of the next frames whose logs name an ability, before any that answers no prompt
    later, found = F.lit(True), []
    for i in (1, 2, 3):
        later = later & F.coalesce(F.col(f"n{i}.reply"), F.lit(False))
        found.append(F.when(later & F.col(f"n{i}.names"), F.col(f"n{i}")))
    rows = rows.withColumn("_then", F.when(activates & ~named & blank(_ref(ability)["name"]), F.coalesce(*found)))
    then = F.col("_then")

    def card(field, attacker, log_field):
        own = F.when(attack, taken[attacker]).otherwise(taken[field])
        inferred = source_log[log_field]
        replace = (raw.isin("PLAY_CARD", "BOOST") & ~named & inferred.isNotNull()) | (activates & blank(own))
        return F.coalesce(then[log_field], F.when(replace, F.coalesce(inferred, own)).otherwise(own))

    sang = F.concat(F.lit(" "), F.lower(F.coalesce(played["message"], F.lit(""))), F.lit(" ")).contains(" sang ")
    infers_play = (raw == "PLAY_CARD") & ~named & (F.size(played["cardRefs"]) > 0)
    infers = infers_play | ((raw == "BOOST") & ~named & (F.size(F.col("_boosted.cardRefs")) > 0)) | (
        activates & (ability.isNotNull() | then.isNotNull()))
    option = lambda m: _filled(F.trim(F.regexp_replace(F.trim(
        F.regexp_extract(m, r"(?i)\bchose\s+(.+)$", 1)), '^"+|"+$', "")))
    no_refs = lambda log: F.coalesce(F.size(log["cardRefs"]), F.lit(0)) <= 0
    choices = F.transform(F.filter("frame_logs", lambda log: log["type"] == "CHOICE_RESOLVED"), lambda log: F.struct(
        log["message"].alias("message"), F.coalesce(log["cardRefs"], F.array()).alias("cards"),
        F.when(no_refs(log), option(log["message"])).alias("option")))
    answers = raw == "RESPOND_TO_PROMPT"
    combat = F.filter("frame_logs", lambda log: (log["type"] == "CARD_ATTACK")
                      & log["data"]["attackerBaseStrength"].isNotNull())
    fight = F.get(combat, F.size(combat) - 1)
    gone = lambda c: F.coalesce(taken[c], F.lit(False))
    outcome = F.when(gone("attackerBanished") & gone("defenderBanished"), "mutual_banish").when(
        gone("defenderBanished"), "defender_banished").when(
        gone("attackerBanished"), "attacker_banished").otherwise("neither_banished")
    side = lambda who: F.struct(
        taken[f"{who}CardId"].alias("card_id"), taken[f"{who}InstanceId"].alias("instance_id"),
        taken[f"{who}Name"].alias("name"), F.col(f"s.{who}_before").alias("before"), F.col(f"s.{who}_after").alias("after"))
    own = F.col("player").eqNullSafe(F.col("perspective"))
    before = F.filter(F.col("s.hand.instance_id"), lambda i: i.isNotNull())
    after = F.filter(F.col("s.hand_after.instance_id"), lambda i: i.isNotNull())
    swap = (raw == "MULLIGAN") & own
    with_instance = lambda cards, keep: F.filter(cards, lambda c: F.array_contains(keep, c["instance_id"]))  # noqa: E731,E501
    logged = F.get(F.filter("frame_logs", lambda log: (log["type"] == "MULLIGAN")
                            & (log["player"] == F.col("perspective"))), F.lit(0))["data"]["mulliganCount"]
    cover = F.filter("undos", covers(F.col("seq")))
    active = F.when(playing & ~is_undo, F.col("s.current_player"))
    return rows.select(
        "game_id", "pos", "seq", raw.alias("raw_type"), F.when(is_undo, "undo").otherwise(kind).alias("type"),
        F.col("player").alias("actor"), own.alias("actor_is_perspective"),
        _player(F.col("names"), F.col("player")).alias("actor_name"),
        active.alias("active_player"), _player(F.col("names"), active).alias("active_player_name"),
        F.when(playing & (own | ~is_undo), F.col("s.current_player")).alias("segment_player"),
        F.when(playing, F.col("s.turn_number")).alias("gameplay_turn"), F.col("turnNumber").alias("frame_turn"),
        "perspective", "game_first_player", "game_warnings", "opening_eligible",
        card("cardId", "attackerCardId", "id").alias("card_id"),
        card("cardName", "attackerName", "name").alias("card_name"),
        F.when(attack, taken["attackerInstanceId"]).otherwise(taken["cardInstanceId"]).alias("card_instance_id"),
        taken["cardType"].alias("card_type"), taken["source"].alias("source"),
        F.when(attack, taken["defenderCardId"]).alias("target_card_id"),
        F.when(attack, taken["defenderInstanceId"]).alias("target_instance_id"),
        F.when(attack, taken["defenderName"]).alias("target_name"),
        F.coalesce(then["ability"], _filled(taken["abilityName"]), F.when(activates, _ability(ability)))
        .alias("ability_name"),
        F.when(infers_play, F.when(sang, "sing").otherwise("play")).alias("play_method"),
        F.when(infers_play & sang, _ref(played, 1)).alias("singer"),
        infers.alias("derived_from_logs"), then["seq"].alias("derived_from_followup_seq"),
        F.when(answers, choices).alias("choices"),
        F.when(answers, F.get(choices, F.lit(0))["option"]).alias("choice_option"),
        F.when(answers, F.col("s.prompt")).alias("prompt"),
        taken["loreGained"].alias("lore_gained"), taken["newLoreTotal"].alias("new_lore_total"),
        F.when(attack, outcome).alias("challenge_outcome"),
        F.when(attack, fight["data"]["actualDamageToDefender"]).alias("damage_dealt"),
        F.when(attack, F.struct(
            side("attacker").alias("attacker"), side("defender").alias("defender"),
            *[taken[c].alias(n) for n, c in (
                ("damage_to_defender", "damageToDefender"), ("damage_to_attacker", "damageToAttacker"),
                ("defender_banished", "defenderBanished"), ("attacker_banished", "attackerBanished"))],
            F.when(fight.isNotNull(), F.struct(*[fight["data"][c].alias(n) for n, c in COMBAT.items()])).alias("combat"),
            fight["message"].alias("resolution_message"))).alias("challenge"),
        F.when(is_undo, undo_target.cast("long")).alias("target_seq"),
        (F.size(cover) > 0).alias("undone"),
        F.array_max(F.transform(cover, lambda u: u["at"])).alias("undone_by_seq"),
        F.when(raw == "CHOOSE_STARTING_PLAYER", F.col("s.first_player")).alias("first_player"),
        *[F.when(own, F.col(f"s.{c}")).alias(c) for c in ("lore", "hand_count", "hand", "ink_count", "ready_ink")],
        F.when(own, F.struct(*[F.col(f"s.{c}").alias(c) for c in (
            "status", "current_player", "turn_number", "has_inked", "deck_count", "field", "items", "inkwell", "discard",
            "opponent_lore", "opponent_hand_count", "opponent_deck_count", "opponent_field", "opponent_items",
            "opponent_inkwell", "opponent_ink_count", "opponent_ready_ink", "opponent_discard")])).alias("board"),
        F.transform("frame_logs", lambda log: F.struct(
            log["id"].alias("id"), log["type"].alias("type"), log["player"].alias("player"),
            log["turnNumber"].alias("turn_number"), log["message"].alias("message"),
            F.coalesce(log["cardRefs"], F.array()).alias("cards"))).alias("logs"),
        F.when(swap, F.col("s.hand")).alias("mulligan_hand"),
        F.when(swap, with_instance(F.col("s.hand"), F.array_intersect(before, after))).alias("mulligan_kept"),
        F.when(swap, with_instance(F.col("s.hand"), F.array_except(before, after))).alias("mulligan_sent"),
        F.when(swap, with_instance(F.col("s.hand_after"), F.array_except(after, before))).alias("mulligan_drawn"),
        F.filter(F.array(F.col("s.warning"), F.when(
            swap & logged.isNotNull() & (logged != F.size(F.array_except(before, after))),
            "mulligan_count_differs")), lambda w: w.isNotNull()).alias("warnings"))


def project_fields(fields: dict[str, Column]) -> Column:
    """Compact JSON of the given fields; NULL values are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
