"""Validators: referential integrity, uniqueness, schema, citations, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fk_violations(specs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphan count per relation ``(name, child, child key, parent, parent key)``.

    NULL keys are not violations. Child keys are counted per value before the anti join, so
    a value that repeats in the child crosses the network once.
    """
    parts = []
    for name, child, key, parent, parent_key in specs:
        keys = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
            F.count(F.lit(1)).alias("_n"))
        orphans = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
        parts.append(orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")).select(
            F.lit(name).alias("relation"), "orphans"))
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def check_schema(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Missing or differently typed columns, as messages; empty when the frame conforms."""
    have = dict(df.dtypes)
    return [f"missing column {c}" if c not in have else f"column {c} is {have[c]}, not {t}"
            for c, t in expected.items() if have.get(c) != t]


def import_outcome(expected: Column, imported: Column) -> Column:
    """no_results when nothing was due, complete when all of it came, else partial."""
    return F.when(expected == 0, "no_results").when(imported >= expected, "complete").otherwise(
        "partial")


def citation_problems(findings: DataFrame, actions: DataFrame, scope: list[str],
                      cited: str, available: str) -> DataFrame:
    """Cited ids that the evidence of the same scope does not contain."""
    refs = findings.select("finding_id", *scope, F.explode(cited).alias(available))
    return refs.join(actions.select(*scope, available).distinct(), [*scope, available],
                     "left_anti")
