"""Action timelines: own turns, undo, follow-ups, log slices, features, openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from matchloom.operators.keyed import top_per_key
from matchloom.operators.ordered import ROWS_PER_BLOCK, number, running, shifted
from matchloom.session import materialize

#: what ``replay_own_turns`` and ``opening_hands`` read of an action table
OPENING_COLUMNS = [
    "game_id", "seq", "type", "actor_is_perspective", "perspective", "game_first_player", "segment_player", "gameplay_turn",
    "card_id", "card_name", "hand", "ink_count", "ready_ink", "undone", "opening_eligible",
    "mulligan_hand", "mulligan_kept", "mulligan_sent", "mulligan_drawn"]


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def own_turns(actions: DataFrame, perspective, first_player,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Number a player's own turns as runs of (active player, label).

    ``perspective`` and ``first_player`` are numbers or columns of the game.

    Rows without an active player or label are skipped. A game whose first row is not the
    first player's label 1 is incomplete and left out. ``own_turn`` is set on rows of the
    player's own segments; ``counts`` marks those that are decisions (undo frames only set a
    border). Games of up to a block of rows are dealt by game and sorted in their tasks; only longer ones
    go through blocks, so ``actions`` are read three times.
    """
    perspective, first_player = _as_column(perspective), _as_column(first_player)
    rows = actions.filter(F.col("active_player").isNotNull() & F.col("turn_label").isNotNull())
    long = materialize(rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_rows") > rows_per_block).select(F.col("game_id").alias("_game")), "long-games")
    same = F.col("game_id").eqNullSafe(F.col("_game"))
    if long.isEmpty():
        return _turns_in_tasks(rows, perspective, first_player).select(*actions.columns, "own_turn", "counts")
    parts = (_turns_in_tasks(rows.join(long, same, "left_anti"), perspective, first_player),
             _turns_in_blocks(rows.join(long, same, "left_semi"), perspective, first_player, rows_per_block))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select(*actions.columns, "own_turn", "counts")


def _turns_in_tasks(rows: DataFrame, perspective: Column, first_player: Column) -> DataFrame:
    game = Window.partitionBy("game_id").orderBy("seq")
    lagged = rows.select("*", F.lag("active_player").over(game).alias("_a"), F.lag("turn_label").over(game).alias("_t"),
                         F.lag(F.lit(1)).over(game).alias("_seen"))
    so_far = game.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = _turn_borders(lagged, perspective, first_player)
    return _own_turns(flagged.select("*", F.sum("_own").over(so_far).alias("_n"), F.sum("_bad").over(so_far).alias("_wrong")),
                      perspective)


def _turns_in_blocks(rows: DataFrame, perspective: Column, first_player: Column, rows_per_block: int) -> DataFrame:
    lagged = shifted(
        number(rows, ["game_id"], ["seq"], rows_per_block).withColumn("_one", F.lit(1)), ["game_id"],
        {"_a": (-1, "active_player"), "_t": (-1, "turn_label"), "_seen": (-1, "_one")},
        rows_per_block)
    out = running(_turn_borders(lagged, perspective, first_player), ["game_id"], {"_n": ("sum", "_own"), "_wrong": ("sum", "_bad")},
                  rows_per_block)
    return _own_turns(out, perspective)


def _turn_borders(lagged: DataFrame, perspective: Column, first_player: Column) -> DataFrame:
    start = F.col("_seen").isNull()
    border = start | (F.col("_a") != F.col("active_player")) | (F.col("_t") != F.col("turn_label"))
    own = F.col("active_player") == perspective
    return lagged.withColumn("_own", F.when(border & own, 1).otherwise(0)).withColumn(
        "_bad", F.when(start & ~((F.col("active_player") == first_player)
                                 & (F.col("turn_label") == 1)), 1).otherwise(0))


def _own_turns(rows: DataFrame, perspective: Column) -> DataFrame:
    own = F.col("active_player") == perspective
    return rows.filter(F.col("_wrong") == 0).select(
        "*", F.when(own, F.col("_n")).alias("own_turn"), (own & (F.col("type") != "undo")).alias("counts"))


def invalidate_ranges(actions: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Mark actions undone: an undo at ``s`` with target ``t`` voids every row in [t, s).

    The latest undo that covers a row has the largest ``s`` among all undos with target at
    or before the row, so one running maximum over rows and undo targets decides it; no
    (undo, action) pairs are formed.
    """
    spans = actions.filter(F.col("target_seq").isNotNull()).select(
        "game_id", F.col("target_seq").alias("at"), F.lit(0).alias("_kind"),
        F.col("seq").alias("_reach"))
    rows = actions.withColumn("at", F.col("seq")).withColumn("_kind", F.lit(1)).withColumn(
        "_reach", F.lit(None).cast("long"))
    line = rows.unionByName(spans, allowMissingColumns=True)
    swept = running(
        number(line, ["game_id"], ["at", "_kind", F.coalesce("_reach", F.col("seq"))],
               rows_per_block), ["game_id"],
        {"_until": ("max", "_reach")}, rows_per_block).filter(F.col("_kind") == 1)
    undone = F.coalesce(F.col("_until") > F.col("seq"), F.lit(False))
    return swept.select(*actions.columns, undone.alias("undone"),
                        F.when(undone, F.col("_until")).alias("undone_by_seq"))


def followup_fill(actions: DataFrame, needs: Column, reply: Column, value: str, ahead: int = 3,
                  rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Take a missing value from the next rows, at most ``ahead``, stopping at a non-reply."""
    marked = actions.withColumn("_reply", reply).withColumn("_need", needs)
    offsets = {}
    for i in range(1, ahead + 1):
        offsets |= {f"_r{i}": (i, "_reply"), f"_v{i}": (i, value), f"_s{i}": (i, "seq")}
    out = shifted(number(marked, ["game_id"], ["seq"], rows_per_block), ["game_id"], offsets, rows_per_block)
    filled, source, still = F.lit(None), F.lit(None), F.lit(True)
    for i in range(1, ahead + 1):
        still = still & F.coalesce(F.col(f"_r{i}"), F.lit(False))
        hit = still & F.col(f"_v{i}").isNotNull()
        filled = F.coalesce(filled, F.when(hit, F.col(f"_v{i}")))
        source = F.coalesce(source, F.when(hit, F.col(f"_s{i}")))
    take = F.col("_need") & F.col(value).isNull()
    kept = [c for c in actions.columns if c != value]
    return out.select(
        *kept, F.when(take, filled).otherwise(F.col(value)).alias(value),
        F.when(take, source).alias("filled_from_seq"))


def log_slices(frames: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Log positions of every frame: [previous count, count), clamped to the total.

    ``frames``: game_id, seq, log_count (NULL keeps the previous count), total_logs and
    base_logs, the count before the first frame. A count that decreases gives an empty slice and a warning, and becomes the new count.
    """
    clamped = F.least("log_count", "total_logs")
    base = number(frames.withColumn("_count", clamped), ["game_id"], ["seq"], rows_per_block)
    known = running(base, ["game_id"], {"_known": ("last", "_count")}, rows_per_block)
    out = shifted(known, ["game_id"], {"_before": (-1, "_known")}, rows_per_block)
    before = F.coalesce("_before", "base_logs", F.lit(0))
    return out.select(
        "game_id", "seq", before.alias("first_log"),
        F.greatest(before, F.coalesce("_count", before)).alias("end_log"),
        F.coalesce(F.col("log_count") < before, F.lit(False)).alias("decreased"),
        F.coalesce(F.col("log_count") > F.col("total_logs"), F.lit(False)).alias("clamped"))


def action_counts(actions: DataFrame, perspective: int) -> DataFrame:
    """Actions per game and type, all and own.

    ``actor`` made the action; ``active_player`` owns the turn, in which the other player may reply.
    """
    return actions.groupBy("game_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if(F.col("actor") == perspective).alias("own_actions"))


def first_action_per_turn(actions: DataFrame, perspective: int) -> DataFrame:
    """The first own action of every turn."""
    own = actions.filter((F.col("actor") == perspective) & F.col("turn_label").isNotNull())
    return top_per_key(own, ["game_id", "turn_label"], [F.col("seq")])


def available_turns(actions: DataFrame, perspective: int) -> DataFrame:
    """Turns in which the player acted."""
    return actions.filter(
        (F.col("actor") == perspective) & F.col("turn_label").isNotNull()
    ).select("game_id", "turn_label").distinct()


def select_turns(actions: DataFrame, perspective: int, turns: list[int] | None = None) -> DataFrame:
    """Rows of the chosen turns; by default each game's first own turn.

    At most two turns; a game where a chosen turn does not exist is left out.
    """
    have = available_turns(actions, perspective)
    if turns:
        chosen = list(dict.fromkeys(turns))
        if len(chosen) > 2:
            raise ValueError("select one or two turns")
        games = have.filter(F.col("turn_label").isin(chosen)).groupBy("game_id").agg(
            F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(chosen)).select("game_id")
        return actions.filter(F.col("turn_label").isin(chosen)).join(games, "game_id", "left_semi")
    first = have.groupBy("game_id").agg(F.min("turn_label").alias("turn_label"))
    return actions.join(first, ["game_id", "turn_label"], "left_semi")


def target_state(card_id: Column, card_name: Column, targets: list[str]) -> Column:
    """True when the card is a target, NULL when its identity is incomplete, else false."""
    from matchloom.functions.text import card_key
    keys = [t.strip().lower() for t in targets]
    hit = card_key(F.coalesce(card_id, F.lit(""))).isin(keys) | card_key(
        F.coalesce(card_name, F.lit(""))).isin(keys)
    whole = (card_id != "") & (card_name != "")
    return F.when(hit, True).when(F.coalesce(whole, F.lit(False)), False)


def target_present(cards: Column, targets: list[str]) -> Column:
    """Any target among an array of (id, name) cards; NULL when absence is not certain."""
    states = F.transform(cards, lambda c: target_state(c["id"], c["name"], targets))
    return F.when(cards.isNull(), None).when(F.exists(states, lambda s: s.eqNullSafe(F.lit(True))), True).when(
        F.exists(states, lambda s: s.isNull()), None).otherwise(False)


def validated_mulligan(hand: Column, kept: Column, sent: Column, drawn: Column, count: Column,
                       warnings: Column, players: Column) -> Column:
    """The exchanged-card count when the evidence is complete and consistent, else NULL.

    Arrays hold card ids. A seven-card hand must equal kept plus sent-back cards as a
    multiset; a warning or a player number other than two (0 = not recorded) voids it.
    """
    def ids(a):
        return a.isNotNull() & F.coalesce(F.forall(a, lambda x: x.isNotNull() & (x != "")), F.lit(False))
    fine = (
        (F.coalesce(warnings, F.lit(0)) == 0) & F.coalesce(players, F.lit(0)).isin(0, 2)
        & ids(hand) & ids(kept) & ids(sent) & ids(drawn) & count.between(0, 7)
        & (F.size(hand) == 7) & (F.size(sent) == count) & (F.size(drawn) == count)
        & (F.size(kept) + count == 7)
        & (F.array_sort(hand) == F.array_sort(F.concat(kept, sent))))
    return F.when(F.coalesce(fine, F.lit(False)), count)


def opening_columns(actions: DataFrame) -> DataFrame:
    """``OPENING_COLUMNS``, of their cards what the opening figures read."""
    return actions.select(*[_told(actions, c).alias(c) for c in OPENING_COLUMNS])


def _told(actions: DataFrame, name: str) -> Column:
    """A column; of cards with many facts the id, the name and whether they make ink."""
    kind = actions.schema[name].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        return F.col(name)
    facts = [f for f in ("id", "name", "inkable") if f in kind.elementType.names]
    return F.transform(name, lambda c: F.struct(*[c[f].alias(f) for f in facts]))


def replay_own_turns(actions: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, written: bool = False) -> DataFrame:
    """Own turns of normalised replays that are complete from the opening on.

    Undone actions are left out. Only the player's own actions count as decisions. The rows are written first, as
    ``own_turns`` reads its input more than once, unless the actions are ``written``; of the hand, id, name and whether a
    card makes ink are kept.
    """
    rows = actions.filter(F.col("opening_eligible") & ~F.col("undone")).select(
        "game_id", "seq", "type", "actor_is_perspective", "perspective", "game_first_player",
        F.col("segment_player").alias("active_player"), F.col("gameplay_turn").alias("turn_label"),
        "card_id", "card_name", _told(actions, "hand").alias("hand"), F.col("ink_count").alias("ink"), "ready_ink")
    rows = rows if written else materialize(rows, "own-actions")
    turns = own_turns(rows, F.col("perspective"), F.col("game_first_player"), rows_per_block)
    return turns.withColumn("counts", F.col("counts") & F.col("actor_is_perspective"))


def _three_valued(hits: str, unsure: str) -> Column:
    return F.when(F.col(hits) > 0, True).when(F.col(unsure) > 0, None).otherwise(False)


def opening_metrics(turn_rows: DataFrame, targets: list[str]) -> DataFrame:
    """First three own turns: completed, ink and ready ink at the end, target seen and played.

    ``turn_rows`` comes from ``own_turns`` with ``ink``, ``ready_ink``, ``hand``, ``card_id``
    and ``card_name``. Seen and played are three-valued: unknown cards never prove absence.
    Every metric is an aggregate that combines map-side.
    """
    rows = turn_rows.filter((F.col("own_turn") <= 3) & F.col("counts"))
    ended, play = F.col("type") == "end_turn", F.col("type") == "play"
    state = target_state(F.col("card_id"), F.col("card_name"), targets)
    sight = target_present(F.col("hand"), targets)
    last = F.when(ended, F.col("seq"))
    agg = rows.groupBy("game_id", "own_turn").agg(
        F.bool_or(ended).alias("complete"), F.max(last).alias("end_seq"),
        F.max_by("ink", last).alias("ink"), F.max_by("ready_ink", last).alias("ready_ink"),
        F.count_if(play & state.eqNullSafe(F.lit(True))).alias("_hit"),
        F.count_if(play & state.isNull()).alias("_unsure"),
        F.count_if(sight.eqNullSafe(F.lit(True))).alias("_seen"),
        F.count_if(sight.isNull()).alias("_unseen"))
    return agg.select(
        "game_id", "own_turn", "complete", "end_seq", F.when(F.col("complete"), F.col("ink")).alias("ink"),
        F.when(F.col("complete"), F.col("ready_ink")).alias("ready_ink"),
        _three_valued("_seen", "_unseen").alias("target_seen"),
        F.when(F.col("complete") | (F.col("_hit") > 0), _three_valued("_hit", "_unsure"))
        .alias("target_played"))


def opening_hands(actions: DataFrame, targets: list[str]) -> DataFrame:
    """Mulligan facts of eligible replays: count, uninkable cards kept, target before and after."""
    rows = actions.filter(F.col("mulligan_hand").isNotNull() & F.col("opening_eligible"))
    count = validated_mulligan(
        F.col("mulligan_hand.id"), F.col("mulligan_kept.id"), F.col("mulligan_sent.id"),
        F.col("mulligan_drawn.id"), F.size("mulligan_sent"), F.lit(0), F.lit(2))
    rows = rows.withColumn("mulligan_count", count)
    valid = F.col("mulligan_count").isNotNull()
    post = F.when(valid, F.concat("mulligan_kept", "mulligan_drawn"))
    known = F.forall(post, lambda c: c["inkable"].isNotNull())
    return rows.select(
        "game_id", "mulligan_count",
        F.when(known, F.size(F.filter(post, lambda c: ~c["inkable"]))).alias("post_uninkables"),
        F.when(valid, target_present(F.col("mulligan_hand"), targets)).alias("initial_target"),
        F.when(valid, target_present(F.col("mulligan_kept"), targets)).alias("kept_target"),
        target_present(post, targets).alias("post_target"))
