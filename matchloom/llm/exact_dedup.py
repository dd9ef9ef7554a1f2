"""Exact dedup against a persistent digest index (operator 1, DataFrame functions only).

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to
one candidate row per digest (a combinable minimum, so a digest that holds a third of the rows
leaves each task as one row), the candidates that are already indexed are removed by a
sort-merge anti-join that needs no shuffle of the index, and the rest is appended. Every
document then looks up the row that represents its digest; that join has two plain shuffles, so
adaptive execution splits a hot digest.

Defined cases. A null text counts as empty, and all empty texts are one group. Of equal texts
the one with the most code points in its original text stays, then the smallest doc_id, a null
doc_id last; of rows that also share the doc_id exactly one stays. Texts indexed by an earlier
batch win over those of a later one: all their rows are dropped, ``keep_id`` names the
earlier document and ``group_size`` counts the rows of this batch. Extra columns of any name
are ignored by ``decide`` and returned untouched by ``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import apply_kept, row_keys, text_of
from matchloom.session import materialize, scratch_path

BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """sha256 (32 bytes) of the text without its ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far with the document that represents each, in buckets by digest.

    ``path`` is a folder that all executors and later applications reach; ``buckets`` is fixed when
    the index is made (about 256 MB a bucket at the size it is meant to reach).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:12]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add digests that are not in the index yet; one file per bucket and batch."""
        (rows.select("digest", "keep_id").repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest")
         .sortBy("digest").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def decide(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept and the row keys.

    Appends the new digests to ``index``.
    """
    text = text_of(docs, text_column)
    seen = materialize(docs.select(
        docs[id_column].cast("long").alias("doc_id"), *row_keys(docs, id_column, text_column),
        digest_of(text).alias("digest"), F.char_length(text).cast("long").alias("_length"),
        F.monotonically_increasing_id().alias("_row")), "digests")
    order = F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("n"),
                     F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    groups = seen.groupBy("digest").agg(F.min(order).alias("_first"),
                                        F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select(
        "digest", F.col("_first.d").alias("keep_id"), F.col("_first.r").alias("_keep_row"),
        "group_size"), "groups")
    known = index.rows()
    fresh = materialize(groups.join(known.hint("merge"), "digest", "left_anti"), "fresh")
    index.append(fresh)
    first_rows = fresh.select("digest", "_keep_row")
    classes = materialize(
        groups.drop("keep_id", "_keep_row").join(index.rows().hint("merge"), "digest")
        .join(first_rows, "digest", "left"), "classes")
    return seen.join(classes, "digest").select(
        "doc_id", "_rid", "_rhash", "digest", "keep_id", "group_size",
        F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = decide(docs, index, id_column, text_column).filter("kept")
    return apply_kept(docs, kept, id_column, text_column)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as shuffles have partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
