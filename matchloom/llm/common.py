"""Pieces shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_LONG = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def row_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Two never-null columns that tell rows apart; only rows equal in id and text share them."""
    return [F.coalesce(docs[id_column].cast("long"), F.lit(LEAST_LONG)).alias("_rid"),
            F.xxhash64(text_of(docs, text_column), docs[id_column].isNull()).alias("_rhash")]


def apply_kept(docs: DataFrame, kept: DataFrame, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (_rid, _rhash) is in ``kept``; rows equal in id and text appear once.

    The join and the removal of repeated rows share one shuffle on the keys, which are all
    but unique. Columns are those of ``docs``, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    keyed = plain.select("*", *row_keys(plain, at[id_column], at[text_column]))
    rows = keyed.join(kept.select("_rid", "_rhash").distinct(), ["_rid", "_rhash"], "left_semi")
    return rows.dropDuplicates(["_rid", "_rhash"]).drop("_rid", "_rhash").toDF(*names)


def picked(docs: DataFrame, **names: str) -> DataFrame:
    """The named columns alone, as ``alias=name``, found by place.

    A column of exactly that name is taken, so another one that differs in case does no harm; without one,
    the only column that differs in case is.
    """
    columns = docs.columns

    def place(name: str) -> int:
        same = [i for i, c in enumerate(columns) if c == name] or [
            i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if len(same) != 1:
            raise ValueError(f"{len(same)} columns are named {name}")
        return same[0]

    plain = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    return plain.select(*[plain[f"_c{place(name)}"].alias(alias) for alias, name in names.items()])
