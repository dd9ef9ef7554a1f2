"""Exact sequential Elo, run as a short series of parallel rounds.

Elo depends on order, but two matches commute unless they share a player. The ordered
matches are cut into epochs; inside an epoch the connected components of the player graph
are independent and are folded in parallel. A component larger than ``group_rows`` is
cut further by sequence range, so no task ever receives more rows than that bound plus the
small components hashed beside it. A player who takes part in a third of all matches is a
true dependency chain: those chunks run one after the other, in bounded memory, while
everything else proceeds in parallel.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.components import component_labels
from matchloom.session import materialize, scratch_path

START_RATING = 1500.0
K_FACTOR = 32.0
GROUP_ROWS = 500_000
MATCHES_PER_PLAYER = 0.3

HISTORY_SCHEMA = (
    "sequence long, match_id long, event_id long, player_id long, opponent_id long, "
    "rating_before double, rating_after double, rating_change double, "
    "opponent_rating_before double, result string"
)


def check_parameters(start_rating: float, k_factor: float) -> dict[str, float]:
    """Start rating and K must be finite numbers, K positive; stored with the run."""
    if not math.isfinite(start_rating):
        raise ValueError("start rating must be finite")
    if not math.isfinite(k_factor) or k_factor <= 0:
        raise ValueError("K must be finite and positive")
    return {"start_rating": float(start_rating), "k_factor": float(k_factor)}


def playable(inputs: DataFrame) -> DataFrame:
    """Rows the calculator accepts: two different players and a draw or a valid winner."""
    p, q, w = F.col("player1_id"), F.col("player2_id"), F.col("winner_id")
    decided = F.coalesce(F.col("is_draw"), F.lit(False)) | F.coalesce(
        (w == p) | (w == q), F.lit(False))
    return inputs.filter(p.isNotNull() & q.isNotNull() & (p != q) & decided)


def _fold(start: float, k: float):
    def run(matches: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        matches = matches.sort_values("sequence")
        rating = dict(zip(state["player_id"].tolist(), state["rating"].tolist()))
        before, after, other = [], [], []
        for p, q, s in zip(matches["player1_id"].tolist(), matches["player2_id"].tolist(),
                           matches["score"].tolist()):
            a, b = rating.get(p, start), rating.get(q, start)
            new_a = a + k * (s - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0)))
            new_b = b + k * ((1.0 - s) - 1.0 / (1.0 + 10.0 ** ((a - b) / 400.0)))
            rating[p], rating[q] = new_a, new_b
            before += (a, b)
            other += (b, a)
            after += (new_a, new_b)
        two = matches.loc[matches.index.repeat(2), ["sequence", "match_id", "event_id"]]
        out = two.reset_index(drop=True)
        sides = matches[["player1_id", "player2_id"]].to_numpy()
        out["player_id"] = sides.ravel()
        out["opponent_id"] = sides[:, ::-1].ravel()
        out["rating_before"], out["rating_after"] = before, after
        out["rating_change"] = out["rating_after"] - out["rating_before"]
        out["opponent_rating_before"] = other
        score = matches["score"].to_numpy().repeat(2)
        score[1::2] = 1.0 - score[1::2]
        out["result"] = pd.Series(score).map({1.0: "WIN", 0.5: "DRAW", 0.0: "LOSS"})
        return out

    return run


def _plan_rounds(matches: DataFrame, total: int, group_rows: int, per_player: float) -> DataFrame:
    """Add ``epoch``, ``chunk`` and ``component`` to every match."""
    if total <= group_rows:  # one bounded group: no graph work needed
        return matches.select(
            "*", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("chunk"),
            F.lit(0).cast("long").alias("component"))
    players = (
        matches.select("player1_id").union(matches.select("player2_id")).distinct().count())
    epoch_rows = max(group_rows, int(per_player * players))
    cut = matches.withColumn("epoch", F.floor((F.col("sequence") - 1) / epoch_rows))
    labels = component_labels(cut, ["epoch"], "player1_id", "player2_id")
    labelled = cut.join(labels.withColumnRenamed("node", "player1_id"), ["epoch", "player1_id"])
    labelled = materialize(labelled, "labelled")
    large = labelled.groupBy("epoch", "component").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > group_rows)
    position = F.col("sequence") - 1 - F.col("epoch") * epoch_rows
    return labelled.join(large, ["epoch", "component"], "left").withColumn(
        "chunk", F.when(F.col("_n").isNotNull(), F.floor(position / group_rows)).otherwise(0)
    ).drop("_n")


def elo_history(inputs: DataFrame, start_rating: float = START_RATING,
                k_factor: float = K_FACTOR, group_rows: int = GROUP_ROWS,
                per_player: float = MATCHES_PER_PLAYER, initial: DataFrame | None = None) -> DataFrame:
    """Two history rows per playable input, identical to the plain sequential loop.

    ``inputs``: sequence, match_id, event_id, player1_id, player2_id, winner_id, is_draw.
    A draw flag beats a winner. ``initial`` (player_id, rating) continues from known ratings.
    The result is a table in the shared folder.
    """
    check_parameters(start_rating, k_factor)
    spark = inputs.sparkSession
    score = F.when(F.col("is_draw"), 0.5).when(
        F.col("winner_id") == F.col("player1_id"), 1.0).otherwise(0.0)
    matches = playable(inputs).select(
        "sequence", "match_id", "event_id", "player1_id", "player2_id", score.alias("score"))
    total = matches.count()
    if total > group_rows:
        matches = materialize(matches, "elo-input")
    planned = _plan_rounds(matches, total, group_rows, per_player)
    if total <= group_rows:
        rounds = [(0, 0, total)] if total else []
    else:
        rounds = [tuple(r) for r in planned.groupBy("epoch", "chunk").count()
                  .orderBy("epoch", "chunk").collect()]  # one small row per round
    if len(rounds) > 1:
        # One folder per round, a few files each: rows are brought together before writing.
        files = max(size for *_, size in rounds) // group_rows + 1
        planned = materialize(
            planned.withColumn("_part", F.concat_ws("-", "epoch", "chunk")).repartition(
                F.col("_part"), F.pmod(F.xxhash64("component"), F.lit(files))), "rounds", "_part")
    path = scratch_path(spark, "elo-history")
    state = initial if initial is not None else spark.createDataFrame(
        [], "player_id long, rating double")
    fold = _fold(float(start_rating), float(k_factor))
    per_task = max(1, group_rows // 8)
    for i, (epoch, chunk, size) in enumerate(rounds):
        current = planned
        if len(rounds) > 1:
            current = planned.filter(F.col("_part") == f"{epoch}-{chunk}")
        buckets = 1 if total <= group_rows else -(-size // per_task)
        current = current.withColumn(
            "bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).drop("_part")
        sides = current.select("bucket", F.col("player1_id").alias("player_id")).union(
            current.select("bucket", F.col("player2_id"))).distinct()
        known = sides.join(state, "player_id").select(
            F.col("bucket").alias("of_bucket"), "player_id", "rating")
        rows = current.groupBy("bucket").cogroup(known.groupBy("of_bucket")).applyInPandas(
            fold, HISTORY_SCHEMA)
        rows.write.parquet(f"{path}/round={i}")
        if i + 1 < len(rounds):
            done = spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/round={i}")
            latest = done.groupBy("player_id").agg(
                F.max_by("rating_after", "sequence").alias("_now"))
            state = materialize(
                state.join(latest, "player_id", "full_outer").select(
                    "player_id", F.coalesce("_now", "rating").alias("rating")), "elo-state")
    if not rounds:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(*[f"{path}/round={i}" for i in range(len(rounds))])


def elo_current(history: DataFrame, start_rating: float = START_RATING) -> DataFrame:
    """Rating, record and peak per player. All aggregates combine before the shuffle."""
    def of(result):
        return F.sum(F.when(F.col("result") == result, 1).otherwise(0))
    return history.groupBy("player_id").agg(
        F.max_by("rating_after", "sequence").alias("rating"),
        F.count(F.lit(1)).alias("matches_played"),
        of("WIN").alias("wins"), of("LOSS").alias("losses"), of("DRAW").alias("draws"),
        F.greatest(F.lit(float(start_rating)), F.max("rating_after")).alias("peak_rating"),
    )
