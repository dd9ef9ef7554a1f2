"""Loads of several tables that become visible together, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.digest import reconcile
from matchloom.operators.quality import duplicates, fk_violations
from matchloom.session import materialize, path_exists, remove_path
from matchloom.sources.conform import Rule, conform_table


@dataclass(frozen=True)
class Table:
    """One table of a load: its raw rows, how columns are made, and the key that must be unique."""
    name: str
    rows: DataFrame
    rules: list[Rule]
    keys: list[str]


@dataclass(frozen=True)
class Relation:
    """``child.key`` must be null or a value of ``parent.parent_key``."""
    child: str
    key: str
    parent: str
    parent_key: str


class TableSet:
    """Tables under ``root`` that readers see as of the newest valid load.

    A load writes all its tables into a folder of its own and checks what was written: no row rejected, all columns
    equal to what was meant by digest, keys unique, relations kept. Only then it is listed, in one file, under the next
    version; taking a version that another load has taken is an error. A load that fails a check is removed, and
    the set before it stays visible. Readers that opened a version keep its files.
    """

    LISTED = "version long, folder string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _newest(self):
        listed = f"{self.root}/listed"
        if not path_exists(self.spark, listed):
            return None
        return self.spark.read.schema(self.LISTED).parquet(f"{listed}/*").orderBy(F.desc("version")).first()

    def read(self, name: str) -> DataFrame | None:
        """The table as of the newest valid load; None before the first."""
        newest = self._newest()
        return self.spark.read.parquet(f"{newest['folder']}/{name}") if newest else None

    def load(self, tables: list[Table], relations: Iterable[Relation] = ()) -> DataFrame:
        """Write, check and, if all checks hold, list the tables. Returns one report row per table."""
        relations, before = list(relations), self._newest()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        pairs, rejected = {}, {}
        for t in tables:
            clean, rejected[t.name] = conform_table(t.rows, t.rules)
            clean.write.parquet(f"{folder}/{t.name}")
            pairs[t.name] = (clean, self.spark.read.schema(clean.schema).parquet(f"{folder}/{t.name}"))
        written = {name: after for name, (_, after) in pairs.items()}
        report = reconcile(pairs, {name: after.columns for name, after in written.items()})
        found = [bad.agg(F.count(F.lit(1)).alias("rejected_rows")).select(F.lit(name).alias("table_name"), "rejected_rows")
                 for name, bad in rejected.items()]
        copies = [duplicates(written[t.name], t.keys).agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_keys")).select(
            F.lit(t.name).alias("table_name"), "duplicate_keys") for t in tables]
        report = report.join(reduce(DataFrame.unionByName, found), "table_name").join(
            reduce(DataFrame.unionByName, copies), "table_name")
        if relations:
            lost = fk_violations([(r.child, written[r.child], r.key, written[r.parent], r.parent_key) for r in relations])
            lost = lost.groupBy(F.col("relation").alias("table_name")).agg(F.sum("orphans").alias("orphans"))
            report = report.join(lost, "table_name", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
        else:
            report = report.withColumn("orphans", F.lit(0).cast("long"))
        sound = F.col("rejected_rows") + F.col("duplicate_keys") + F.col("orphans") == 0
        report = materialize(report.withColumn("valid", F.col("valid") & sound), "load-report")
        if report.filter(~F.col("valid")).isEmpty():
            version = (before["version"] if before else 0) + 1
            self.spark.createDataFrame([(version, folder)], self.LISTED).coalesce(1).write.mode("errorifexists").parquet(
                f"{self.root}/listed/version-{version}")
        else:
            remove_path(self.spark, folder)
        return report
