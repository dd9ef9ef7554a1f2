"""Versioned eligibility policies: ordered (reason, predicate) lists evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.keyed import classify, fails

# Policy names with their short forms, and the rated formats.
POLICY_NAMES = {
    "legacy": "legacy_parity_v1", "legacy_parity_v1": "legacy_parity_v1",
    "global": "global_elo_v1", "global_elo_v1": "global_elo_v1",
}
RATED_FORMATS = ["Core Constructed", "Infinity Constructed"]
INCLUDED = "included"


def _is(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def match_rules() -> list[tuple[str, Column]]:
    p1, p2, winner = F.col("player1_id"), F.col("player2_id"), F.col("winner_id")
    return [
        ("match_not_complete", fails(F.col("match_status"), "COMPLETE")),
        ("bye", _is("is_bye")),
        ("ghost_match", _is("is_ghost_match")),
        ("not_two_player", fails(F.col("participant_count"), 2)),
        ("missing_player", p1.isNull() | p2.isNull()),
        ("same_player", p1.eqNullSafe(p2)),
        ("missing_result", winner.isNull() & ~_is("is_draw")),
        ("invalid_winner",
         winner.isNotNull() & ~winner.eqNullSafe(p1) & ~winner.eqNullSafe(p2)),
        ("missing_event_start", F.col("event_start_datetime").isNull()),
    ]


def event_rules() -> list[tuple[str, Column]]:
    return [
        ("unsupported_event_format",
         ~F.coalesce(F.col("event_format").isin(RATED_FORMATS), F.lit(False))),
        ("event_not_complete", fails(F.col("event_sync_state"), "complete")),
    ]


_REGISTRY = {
    "legacy_parity_v1": match_rules,
    "global_elo_v1": lambda: match_rules() + event_rules(),
}


def policy_name(name: str) -> str:
    key = name.strip().lower()
    if key in _REGISTRY:
        return key
    if key not in POLICY_NAMES:
        raise ValueError(f"Unknown rating policy: {name}")
    return POLICY_NAMES[key]


def register_policy(name: str, rules) -> None:
    """Plug in a policy: ``rules()`` returns the ordered (reason, predicate) list."""
    _REGISTRY[name.strip().lower()] = rules


def with_reason(candidates: DataFrame, policy: str, out: str = "reason") -> DataFrame:
    return candidates.withColumn(out, classify(_REGISTRY[policy_name(policy)](), INCLUDED))


def reason_counts(candidates: DataFrame, policy: str) -> DataFrame:
    return with_reason(candidates, policy).groupBy("reason").agg(
        F.count(F.lit(1)).alias("matches"))
