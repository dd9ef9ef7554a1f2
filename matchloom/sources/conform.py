"""Declarative conversion of text-typed legacy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import uuid5
from matchloom.functions.times import parse_timestamp
from matchloom.operators.digest import reconcile
from matchloom.operators.keyed import one_row
from matchloom.operators.quality import check_schema

# Legacy status words and what they became.
IMPORT_STATUS = {"SUCCESS": "complete", "FAILED": "failed", "NO_RESULTS": "no_results",
                 "PARTIAL": "partial"}
DISCOVERY_STATUS = {"SUCCESS": "complete", "FAILED": "failed"}
SYNC_STATE = {"NOT_ATTEMPTED": "pending", "SUCCESS": "complete", "FAILED": "failed",
              "NO_RESULTS": "no_results", "PARTIAL": "partial"}


@dataclass(frozen=True)
class Rule:
    """How one target column is made: ``kind`` is copy, timestamp, boundary, flag, map, uuid."""
    target: str
    source: str
    kind: str = "copy"
    nullable: bool = True
    mapping: dict = field(default_factory=dict)
    namespace: str = ""
    prefix: str = ""


def _convert(rule: Rule) -> Column:
    c = F.col(rule.source)
    if rule.kind == "copy":
        return c
    if rule.kind == "timestamp":
        zoned = c.rlike(r"[Tt ].*(Z|[+-]\d{2}:?\d{2})$")
        return F.when(zoned, parse_timestamp(c))
    if rule.kind == "boundary":
        dated = F.concat(c, F.lit("T00:00:00Z"))
        return F.when(F.length(c) == 10, parse_timestamp(dated)).otherwise(parse_timestamp(c))
    if rule.kind == "flag":
        return F.when(c == 1, True).when(c == 0, False)
    if rule.kind == "map":
        out = F.lit(None).cast("string")
        for old, new in rule.mapping.items():
            out = F.when(c == old, new).otherwise(out)
        return out
    if rule.kind == "uuid":
        return uuid5(rule.namespace, F.concat(F.lit(f"{rule.prefix}:"), c.cast("string")))
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def conform_table(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows with the offending target columns). One pass, no shuffle."""
    made, problems = [], []
    for r in rules:
        value = _convert(r)
        made.append(value.alias(r.target))
        lost = F.col(r.source).isNotNull() & value.isNull()
        problems.append(F.when(lost | (F.lit(not r.nullable) & value.isNull()), r.target))
    marked = df.withColumn("errors", F.filter(F.array(*problems), lambda x: x.isNotNull()))
    return (marked.filter(F.size("errors") == 0).select(*made),
            marked.filter(F.size("errors") > 0))


def preflight(df: DataFrame, expected: dict[str, str], rules: list[Rule]) -> DataFrame:
    """Row and error counts of a conversion after the schema check, without keeping it."""
    problems = check_schema(df, expected)
    if problems:
        raise ValueError("; ".join(problems))
    clean, rejected = conform_table(df, rules)
    return one_row(clean.agg(F.count(F.lit(1)).alias("clean_rows")),
                   rejected.agg(F.count(F.lit(1)).alias("rejected_rows")))


def load_and_reconcile(df: DataFrame, rules: list[Rule], path: str, columns: list[str]) -> DataFrame:
    """Write the clean rows and compare what was written with what was meant.

    The report is one row; the caller moves its pointer to ``path`` only when ``valid``.
    """
    clean, rejected = conform_table(df, rules)
    clean.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.schema(clean.schema).parquet(path)
    report = reconcile({"load": (clean, written)}, {"load": columns})
    bad = rejected.agg(F.count(F.lit(1)).alias("rejected_rows"), F.lit("load").alias("table_name"))
    return one_row(report, bad, by=["table_name"]).withColumn(
        "valid", F.col("valid") & (F.col("rejected_rows") == 0))
