"""Checks on review findings and their citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.keyed import classify

# Accepted words of a finding.
IMPACTS = ["low", "medium", "high"]
CLAIMS = ["fact", "inference"]
BASES = ["replay_observation", "strategic_inference", "rules_interpretation"]


def _blank(c):
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _no(c):
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def finding_problem(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """First problem of every finding, or ``valid``.

    Cited action numbers and turns must exist in the evidence of the same game: citations
    are counted against it with a semi join, one row per distinct citation.
    """
    def cited(column, available):
        refs = findings.select("finding_id", "game_id", F.explode(column).alias(available)).distinct()
        have = actions.select("game_id", available).distinct().withColumn("_ok", F.lit(1))
        return refs.join(have, ["game_id", available], "left").groupBy("finding_id").agg(
            F.count_if(F.col("_ok").isNull()).alias(f"_lost_{available}"))
    rows = findings.join(cited("action_ids", "seq"), "finding_id", "left").join(
        cited("turns", "turn_label"), "finding_id", "left")
    confidence = F.col("confidence")
    return rows.select("finding_id", "game_id", classify([
        ("blank_text", _blank("category") | _blank("observation") | _blank("recommendation")),
        ("invalid_impact", ~F.coalesce(F.col("impact").isin(IMPACTS), F.lit(False))),
        ("invalid_claim", ~F.coalesce(F.col("claim_type").isin(CLAIMS), F.lit(False))),
        ("invalid_confidence", ~F.coalesce(confidence.between(0.0, 1.0), F.lit(False))),
        ("no_citation", _no("action_ids") & _no("turns")),
        ("unknown_action", F.coalesce("_lost_seq", F.lit(0)) > 0),
        ("invalid_basis", ~F.coalesce(F.col("claim_basis").isin(BASES), F.lit(False))),
        ("not_an_inference", (F.col("claim_basis") != "replay_observation")
         & (F.col("claim_type") != "inference")),
        ("rules_need_sources", (F.col("claim_basis") == "rules_interpretation")
         & (_no("rule_refs") | _no("card_refs"))),
        ("unknown_turn", F.coalesce("_lost_turn_label", F.lit(0)) > 0),
    ], "valid").alias("problem"))


def held_for_review(findings: DataFrame, durations: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Games whose advice speaks of lore in the next turn while one of their cards has an effect that ends before it.

    ``durations``: game_id of cards whose effects expire at the start of the next turn; ``summaries``: game_id, summary.
    Words may stand in different findings of a game, so a game is looked at as a whole; flags combine before the shuffle.
    """
    said = findings.select("game_id", F.lower(F.concat_ws(" ", "observation", "recommendation")).alias("_text"))
    if summaries is not None:
        said = said.unionByName(summaries.select("game_id", F.lower("summary").alias("_text")))
    return said.groupBy("game_id").agg(
        F.bool_or(F.col("_text").contains("next turn")).alias("_turn"), F.bool_or(F.col("_text").contains("lore")).alias("_lore")
    ).filter("_turn and _lore").select("game_id").join(durations.select("game_id").distinct(), "game_id")


def bundle_dates(bundles: DataFrame) -> DataFrame:
    """Problem of each bundle's own facts: its dates in order, and something to cite."""
    return bundles.select("bundle_id", classify([
        ("no_dates", F.col("effective_from").isNull() | F.col("verified_through").isNull()),
        ("dates_reversed", F.coalesce(F.col("verified_through") < F.col("effective_from"), F.lit(False))),
        ("no_citations", F.coalesce(F.col("citations"), F.lit(0)) <= 0)], "valid").alias("problem"))


def bundle_problem(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Integrity of a reference bundle per passage: document known, text present, hash right."""
    docs = documents.select("document_id", F.lit(True).alias("_known"))
    return passages.join(docs, "document_id", "left").select("passage_id", classify([
        ("unknown_document", F.col("_known").isNull()), ("empty_passage", _blank("text")),
        ("checksum_mismatch", ~F.sha2("text", 256).eqNullSafe(F.col("sha256")))],
        "valid").alias("problem"))
