"""Content digests that combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.keyed import one_row

LANES = 2


def row_digest(columns: list[str]) -> Column:
    """sha256 of the columns in name order; NULL and empty text differ.

    A separator inside a value is doubled, so that values cannot run into each other.
    """
    sep = F.lit("\u001f")
    parts = [
        F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), sep, F.concat(sep, sep))),
                   F.lit("~"))
        for c in sorted(columns)
    ]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and order-independent digest of a table, as one row.

    The sha256 of every row is split into two 60-bit lanes which are summed as decimals.
    Sums do not depend on row order, keep multiplicity, and combine before the shuffle, so
    a table with many equal rows costs no more than any other.
    """
    rows = df.select(row_digest(columns).alias("h"))
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
        for i in range(LANES)
    ]
    summed = rows.agg(F.count(F.lit(1)).alias("row_count"), *lanes)
    text = F.concat_ws(
        ":", F.col("row_count").cast("string"),
        *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string")
          for i in range(LANES)])
    return summed.select("row_count", F.sha2(text, 256).alias("digest"))


def ordered_digest(df: DataFrame, sequence: str, line: Column, fan_in: int = 4096) -> DataFrame:
    """Digest of lines in sequence order, as a tree with at most ``fan_in`` lines per node.

    Only the depth of the tree grows with the table; no task ever holds more than
    ``fan_in`` digests.
    """
    level = df.select((F.col(sequence) - 1).alias("i"), F.sha2(line, 256).alias("h"))
    size = df.agg(F.count(F.lit(1))).first()[0]
    width = max(size, 1)
    while True:
        level = (
            level.groupBy(F.floor(F.col("i") / F.lit(fan_in)).alias("i"))
            .agg(F.sha2(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "\n"), 256)
                .alias("h"))
        )
        width = -(-width // fan_in)
        if width <= 1:
            break
    return level.agg(F.lit(size).cast("long").alias("row_count"), F.max("h").alias("digest"))


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]], columns: dict[str, list[str]]) -> DataFrame:
    """Source against target: row counts and digests per table name."""
    sides = []
    for name, (source, target) in pairs.items():
        for side, df in (("source", source), ("target", target)):
            sides.append(table_digest(df, columns[name]).select(
                F.lit(name).alias("table_name"), F.col("row_count").alias(f"{side}_rows"),
                F.col("digest").alias(f"_{side}")))
    equal = F.col("_source") == F.col("_target")
    return one_row(*sides, by=["table_name"]).select(
        "table_name", "source_rows", "target_rows", equal.alias("digest_match"),
        (equal & (F.col("source_rows") == F.col("target_rows"))).alias("valid"))
