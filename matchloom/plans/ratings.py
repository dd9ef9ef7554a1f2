"""Rating candidates, runs, and everything read from a published run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.digest import ordered_digest
from matchloom.operators.keyed import classify, one_row, top_per_key
from matchloom.operators.ordered import assign_sequence, global_rank
from matchloom.plans.elo import K_FACTOR, START_RATING, check_parameters, elo_current, elo_history
from matchloom.plans.policies import INCLUDED, policy_name, with_reason
from matchloom.session import path_exists, remove_path

ALGORITHM = "elo_v1"
INPUT_ORDER = ["event_start_datetime", "event_id", "phase_order", "round_number", "match_id"]
INPUT_COLUMNS = ["match_id", "event_id", "round_id", "player1_id", "player2_id", "winner_id",
                 "is_draw", "event_start_datetime", "phase_order", "round_number"]


def rating_candidates(matches, events, rounds, phases, sync_state) -> DataFrame:
    """Match facts with their event, round, phase and import state; missing order is 0."""
    return (
        matches.join(events.select(
            "event_id", F.col("start_datetime").alias("event_start_datetime"),
            F.col("format").alias("event_format")), "event_id")
        .join(rounds.select("round_id", "phase_id", "round_number"), "round_id", "left")
        .join(phases.select("phase_id", "phase_order"), "phase_id", "left")
        .join(sync_state.select("event_id", F.col("state").alias("event_sync_state")),
              "event_id", "left")
        .withColumn("phase_order", F.coalesce("phase_order", F.lit(0)))
        .withColumn("round_number", F.coalesce("round_number", F.lit(0)))
    )


def rating_inputs(candidates: DataFrame, policy: str) -> DataFrame:
    """Included candidates numbered 1..n in the rating order."""
    kept = with_reason(candidates, policy).filter(F.col("reason") == INCLUDED)
    return assign_sequence(kept.select(*INPUT_COLUMNS), [F.col(c) for c in INPUT_ORDER])


def input_line() -> Column:
    """Canonical text of one input, hashed into the run's ordered digest."""
    fields = ["sequence", "match_id", "event_id", "player1_id", "player2_id"]
    return F.concat_ws(
        "|", *[F.col(c).cast("string") for c in fields],
        F.coalesce(F.col("winner_id").cast("string"), F.lit("-")),
        F.when(F.col("is_draw"), "1").otherwise("0"))


@dataclass(frozen=True)
class Run:
    run_id: str
    inputs: DataFrame
    history: DataFrame
    current: DataFrame


class RunStore:
    """Immutable rating runs under one folder, with append-only run and publication logs.

    A run's tables are written first and its ``validated`` row last, so readers never see a
    half-written run; a failed build leaves the published pointer where it was.
    """

    RUNS = ("run_id string, policy string, algorithm string, start_rating double, "
            "k_factor double, input_count long, digest string, status string, note string, "
            "logged_at timestamp")
    PUBLICATIONS = ("publication string, current_run string, previous_run string, "
                    "version long, published_at timestamp")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        df = self.spark.createDataFrame([row], schema.rsplit(",", 1)[0])
        stamp = schema.rsplit(",", 1)[1].split()[0]
        df.withColumn(stamp, F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        """Latest state of every run."""
        return top_per_key(self._log("runs", self.RUNS), ["run_id"],
                           [F.col("logged_at").desc(), F.col("status").desc()])

    def publications(self) -> DataFrame:
        return top_per_key(self._log("publications", self.PUBLICATIONS), ["publication"],
                           [F.col("version").desc()])

    def open(self, run_id: str) -> Run:
        base = f"{self.root}/run_id={run_id}"
        read = self.spark.read.parquet
        return Run(run_id, read(f"{base}/inputs"), read(f"{base}/history"),
                   read(f"{base}/current"))

    def published(self, publication: str) -> Run | None:
        row = self.publications().filter(F.col("publication") == publication).first()
        return self.open(row["current_run"]) if row else None

    def find(self, policy: str, params: dict, count: int, digest: str):
        return self.runs().filter(
            F.col("status").isin("validated", "published")
            & (F.col("policy") == policy) & (F.col("algorithm") == ALGORITHM)
            & (F.col("start_rating") == params["start_rating"])
            & (F.col("k_factor") == params["k_factor"])
            & (F.col("input_count") == count) & (F.col("digest") == digest)).first()

    def build(self, candidates: DataFrame, policy: str = "global",
              start_rating: float = START_RATING, k_factor: float = K_FACTOR) -> tuple[str, bool]:
        """Build a validated run; (run id, False) when an equal run already exists."""
        policy = policy_name(policy)
        params = check_parameters(start_rating, k_factor)
        inputs = rating_inputs(candidates, policy)  # backed by the written, numbered table
        mark = ordered_digest(inputs, "sequence", input_line()).first()
        count, digest = mark["row_count"], mark["digest"]
        same = self.find(policy, params, count, digest)
        if same:
            return same["run_id"], False
        run_id = uuid.uuid4().hex
        base = f"{self.root}/run_id={run_id}"
        meta = (run_id, policy, ALGORITHM, params["start_rating"], params["k_factor"],
                count, digest)
        self._append("runs", self.RUNS, (*meta, "building", None))
        try:
            inputs.write.parquet(f"{base}/inputs")
            stored = self.spark.read.schema(inputs.schema).parquet(f"{base}/inputs")
            history = elo_history(stored, start_rating, k_factor)
            history.write.parquet(f"{base}/history")
            elo_current(history, start_rating).write.parquet(f"{base}/current")
            checks = run_invariants(self.open(run_id)).first().asDict()
            broken = sorted(k for k, ok in checks.items() if ok is False)
            if broken:
                raise ValueError("run invariants failed: " + ", ".join(broken))
        except Exception as error:
            self._append("runs", self.RUNS, (*meta, "failed", str(error)[:4000]))
            remove_path(self.spark, base)
            raise
        self._append("runs", self.RUNS, (*meta, "validated", None))
        return run_id, True

    def publish(self, publication: str, run_id: str) -> None:
        """Rotate current to previous. Publishing the current run again changes nothing."""
        state = self.runs().filter(F.col("run_id") == run_id).first()
        if state is None or state["status"] not in ("validated", "published"):
            raise ValueError("only validated runs can be published")
        now = self.publications().filter(F.col("publication") == publication).first()
        if now and now["current_run"] == run_id:
            return
        self._append("publications", self.PUBLICATIONS, (
            publication, run_id, now["current_run"] if now else None,
            (now["version"] if now else 0) + 1))

    def build_and_publish_if_changed(self, publication: str, candidates: DataFrame,
                                     policy: str = "global") -> tuple[str, bool]:
        run_id, created = self.build(candidates, policy)
        self.publish(publication, run_id)
        self.prune()
        return run_id, created

    def prune(self) -> list[str]:
        """Drop every finished run that no publication points to."""
        runs = self.runs()
        doomed = runs.join(plan_prune(runs, self.publications()), "run_id", "left_semi").collect()
        for r in doomed:  # logged first: a run that is half removed is never found again
            meta = [r[c.split()[0]] for c in self.RUNS.split(", ")[:7]]
            self._append("runs", self.RUNS, (*meta, "pruned", None))
            remove_path(self.spark, f"{self.root}/run_id={r['run_id']}")
        return [r["run_id"] for r in doomed]


def plan_prune(runs: DataFrame, publications: DataFrame) -> DataFrame:
    """Runs to drop: not building and not current or previous of any publication."""
    kept = publications.select(F.explode(F.array("current_run", "previous_run")).alias("run_id"))
    return runs.filter(~F.col("status").isin("building", "pruned")).join(
        kept.filter(F.col("run_id").isNotNull()), "run_id", "left_anti").select("run_id")


def run_invariants(run: Run) -> DataFrame:
    """One row of boolean checks over a run's tables."""
    i = run.inputs.agg(
        F.count(F.lit(1)).alias("n"), F.max("sequence").alias("hi"), F.min("sequence").alias("lo"),
        F.sum("sequence").cast("decimal(38,0)").alias("seq_sum"))
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    h = run.history.agg(
        F.count(F.lit(1)).alias("h"),
        F.coalesce(F.bool_and(finite("rating_after")), F.lit(True)).alias("h_finite"))
    c = run.current.agg(
        F.count(F.lit(1)).alias("players"),
        F.coalesce(F.bool_and(finite("rating") & finite("peak_rating")), F.lit(True))
        .alias("c_finite"),
        F.coalesce(F.bool_and(F.col("matches_played") == F.col("wins") + F.col("losses")
                              + F.col("draws")), F.lit(True)).alias("records"),
        F.coalesce(F.sum("matches_played"), F.lit(0)).alias("played"))
    p = run.history.select("player_id").distinct().agg(F.count(F.lit(1)).alias("seen"))
    n = F.col("n")
    expected = n.cast("decimal(18,0)") * (n + 1).cast("decimal(18,0)") / 2
    return one_row(i, h, c, p).select(
        ((n == 0) | ((F.col("lo") == 1) & (F.col("hi") == n) & (F.col("seq_sum") == expected)))
        .alias("contiguous_sequence"),
        (F.col("h") == 2 * n).alias("two_rows_per_input"),
        (F.col("played") == 2 * n).alias("all_processed"),
        F.col("h_finite").alias("finite_history"), F.col("c_finite").alias("finite_current"),
        F.col("records").alias("records_add_up"),
        (F.col("players") == F.col("seen")).alias("current_matches_players"))


def run_counts(run: Run, minimum_matches: int = 0) -> DataFrame:
    """One row: inputs, history rows, rated players, and players with at least ``minimum_matches`` matches."""
    return one_row(
        run.inputs.agg(F.count(F.lit(1)).alias("inputs")), run.history.agg(F.count(F.lit(1)).alias("history")),
        run.current.agg(F.count(F.lit(1)).alias("players"),
                        F.count_if(F.col("matches_played") >= minimum_matches).alias("eligible_players")))


# --- reads -----------------------------------------------------------------------------

DEEP_PAGE = 10_000


def rank_order() -> list[Column]:
    return [F.col("rating").desc(), F.col("matches_played").desc(), F.col("player_id")]


def leaderboard(current: DataFrame, players: DataFrame, limit: int = 25, offset: int = 0,
                minimum_matches: int = 0) -> DataFrame:
    """A page of the ranking; players below the minimum do not take up ranks.

    A page near the top is a distributed top-k (each task keeps offset + limit rows), so only
    those rows are numbered; a deep page numbers the ranking with the range sort instead.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if offset < 0:
        raise ValueError("offset must be non-negative")
    eligible = current.filter(F.col("matches_played") >= minimum_matches)
    if offset + limit <= DEEP_PAGE:
        page = eligible.orderBy(*rank_order()).limit(offset + limit)
        ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))
    else:
        ranked = assign_sequence(eligible, rank_order(), "rank").filter(
            F.col("rank") <= offset + limit)
    return ranked.filter(F.col("rank") > offset).join(
        players, "player_id", "left").select(
        "rank", "player_id", "display_name", "username", "rating", "matches_played", "wins",
        "losses", "draws", "peak_rating")


def full_ranking(current: DataFrame) -> DataFrame:
    """Row rank, competition rank and percentile of every rated player.

    The percentile is 100 when only one player is rated.
    """
    return global_rank(current, rank_order(), "rating").withColumn(
        "percentile", F.when(F.col("total") <= 1, 100.0).otherwise(
            F.col("below") / (F.col("total") - 1) * 100.0))


def recent_form(history: DataFrame, sizes: tuple[int, ...] = (10, 25)) -> DataFrame:
    """Record over the last N matches and rating change over the largest N, per player."""
    top = top_per_key(history, ["player_id"], [F.col("sequence").desc()], max(sizes), "_rn")

    def count(result, n):
        return F.sum(F.when((F.col("result") == result) & (F.col("_rn") <= n), 1).otherwise(0))
    aggs = [count(r, n).alias(f"{label}_{n}") for n in sizes
            for r, label in (("WIN", "wins"), ("LOSS", "losses"), ("DRAW", "draws"))]
    return top.groupBy("player_id").agg(
        *aggs, F.sum("rating_change").alias(f"rating_change_{max(sizes)}"))


def best_win(history: DataFrame, players: DataFrame, events: DataFrame) -> DataFrame:
    """The win over the highest-rated opponent; ties by rating gained, then latest."""
    won = top_per_key(
        history.filter(F.col("result") == "WIN"), ["player_id"],
        [F.col("opponent_rating_before").desc(), F.col("rating_change").desc(),
         F.col("sequence").desc()])
    names = players.select(F.col("player_id").alias("opponent_id"),
                           F.col("display_name").alias("opponent_name"))
    return won.join(names, "opponent_id", "left").join(
        events.select("event_id", F.col("name").alias("event_name")), "event_id", "left").select(
        "player_id", "opponent_id", "opponent_name", "event_name",
        F.col("opponent_rating_before").alias("opponent_rating"), "rating_change")


def expected_score(own: Column, other: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))


def player_profile(current, history, players) -> DataFrame:
    """Every player: rank, percentile, form, opposition strength, expected against actual."""
    actual = F.when(F.col("result") == "WIN", 1.0).when(F.col("result") == "DRAW", 0.5).otherwise(0.0)
    totals = history.groupBy("player_id").agg(
        F.avg("opponent_rating_before").alias("average_opponent_rating"),
        F.sum(expected_score(F.col("rating_before"), F.col("opponent_rating_before")))
        .alias("expected_score_total"),
        F.sum(actual).alias("actual_score_total"))
    ranked = full_ranking(current).select(
        "player_id", "rating", "peak_rating", "matches_played", "rank", "percentile")
    rated = ranked.join(recent_form(history), "player_id").join(totals, "player_id")
    return players.select("player_id", "display_name").join(rated, "player_id", "left").withColumn(
        "has_rating", F.col("rating").isNotNull())


def entity_history(matches, events, rounds, phases, registrations, players, inputs) -> DataFrame:
    """Every player's tournament history: one row per player and match."""
    def side(me, other, mine, theirs):
        return F.struct(F.col(me).alias("player_id"), F.col(other).alias("opponent_id"),
                        F.col(mine).alias("player_score"), F.col(theirs).alias("opponent_score"))
    both = F.array(side("player1_id", "player2_id", "player1_score", "player2_score"),
                   side("player2_id", "player1_id", "player2_score", "player1_score"))
    # A match against oneself is one history row, as with an OR over both sides.
    sides = F.filter(both, lambda s, i: s["player_id"].isNotNull() & (
        (i == 0) | ~s["player_id"].eqNullSafe(s["opponent_id"])))
    rows = matches.withColumn("_side", F.explode(sides)).select("*", "_side.*")
    result = classify([
        ("BYE", F.coalesce("is_bye", F.lit(False))), ("DRAW", F.coalesce("is_draw", F.lit(False))),
        ("WIN", F.col("winner_id").eqNullSafe(F.col("player_id"))),
        ("LOSS", F.col("winner_id").isNotNull())], "UNKNOWN")
    return (
        rows.withColumn("result", result)
        .join(events.select("event_id", F.col("name").alias("event_name"), "start_datetime"), "event_id")
        .join(rounds.select("round_id", "round_number", "phase_id"), "round_id", "left")
        .join(phases.select("phase_id", "phase_name", "phase_order"), "phase_id", "left")
        .join(registrations.select("event_id", "player_id", "matches_won", "matches_lost",
                                   "matches_drawn", "placement"), ["event_id", "player_id"], "left")
        .join(players.select(F.col("player_id").alias("opponent_id"),
                             F.col("display_name").alias("opponent_name")), "opponent_id", "left")
        .join(inputs.select("match_id", F.lit(True).alias("_rated")), "match_id", "left")
        .withColumn("rated", F.col("_rated").isNotNull())
        .select("player_id", "event_id", "event_name", "start_datetime", "match_id", "phase_name",
                "phase_order", "round_number", "opponent_id", "opponent_name", "player_score",
                "opponent_score", "result", "rated", "is_intentional_draw", "matches_won",
                "matches_lost", "matches_drawn", "placement")
    )


def event_rollup(rows: DataFrame) -> DataFrame:
    """Per player and event: the recorded result, else the one derived from the matches."""
    def of(result):
        return F.sum(F.when(F.col("result") == result, 1).otherwise(0))
    grouped = rows.groupBy("player_id", "event_id").agg(
        of("WIN").alias("_w"), of("LOSS").alias("_l"), of("DRAW").alias("_d"),
        F.max("matches_won").alias("_mw"), F.max("matches_lost").alias("_ml"),
        F.max("matches_drawn").alias("_md"), F.max("placement").alias("placement"),
        F.count(F.lit(1)).alias("matches"),
        F.sum(F.col("rated").cast("int")).alias("rated_matches"))
    return grouped.select(
        "player_id", "event_id", F.coalesce("_mw", "_w").alias("wins"),
        F.coalesce("_ml", "_l").alias("losses"), F.coalesce("_md", "_d").alias("draws"),
        "placement", "matches", "rated_matches")


def search_players(players: DataFrame, current: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Digits find one id; other text matches names, exact names first, then by rating.

    ``%`` and ``_`` in the query keep their pattern meaning.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    text = query.strip()
    rated = current.select("player_id", "rating", "matches_played")
    columns = ["player_id", "display_name", "username", "rating", "matches_played"]
    if text.isdigit():
        return players.filter(F.col("player_id") == int(text)).join(
            rated, "player_id", "left").select(*columns)
    exact = text.lower()
    display = F.lower(F.coalesce("display_name", F.lit("")))
    username = F.lower(F.coalesce("username", F.lit("")))
    tier = F.when(display == exact, 0).when(username == exact, 1).otherwise(2)
    found = players.filter(display.like(f"%{exact}%") | username.like(f"%{exact}%"))
    return found.join(rated, "player_id", "left").orderBy(
        tier, F.col("rating").desc_nulls_last(), "player_id").limit(limit).select(*columns)
