"""SimHash near-dedup by anchor-point covering (operator 5).

Each text gets a 64-bit fingerprint of its 3-word shingles. Two fingerprints that differ in at most
two bits differ in at most one bit of one of the two 32-bit halves. On 31 bits of a half the Hamming
code [31, 26] is a perfect covering: every value lies within one bit of exactly one code word, its
anchor. A pair with at most one differing bit there has the anchor of one value within two bits of
the other, so a fingerprint is filed at its own anchor and looked up at every anchor within
covering radius plus threshold (1 + 1), which are at most sixteen. Fingerprints are compared
per anchor over all 64 bits; no link is lost and random pairs rarely meet.

Only distinct fingerprints are compared: documents with one fingerprint form one row first, so a
group of thousands of copies costs one comparison. Links never form copies x copies pairs; they
are bounded by the 2,080 fingerprints within two bits of one.

Tables with a row for each fingerprint are joined by sorting, so none of them passes through the driver, whatever
size Spark would broadcast.

Defined cases. Texts without words (null, empty, blank) have fingerprint zero and link like any
other; texts of one or two words hash the whole sequence. A null doc_id is never a component's id unless
all its documents have none. Repeated rows give repeated result rows. Extra columns
are ignored by ``components`` and returned untouched by ``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import apply_kept, row_keys, text_of
from matchloom.operators.components import component_labels
from matchloom.session import materialize

SHINGLE = 3
SEED = 42
MOST_BITS = 2
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return F.pandas_udf(compute, "long")(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _half(value: Column, half: int) -> Column:
    return F.shiftright(value, 32 * half).bitwiseAND(F.lit((1 << 31) - 1))


def _syndrome(bits: Column) -> Column:
    """Number (1-31) of the bit whose change makes a code word; 0 for a code word."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out = out + (F.bit_count(bits.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return out


def _masks() -> list[list[int]]:
    """For each syndrome the changes that lead to the own anchor, then to all others within two bits."""
    flip = [0] + [1 << (i - 1) for i in range(1, 32)]
    return [[flip[s]] + [flip[i] ^ flip[s ^ i] for i in range(1, 32) if s ^ i > i and s] for s in range(32)]


def anchors(value: Column, half: int, near: bool) -> Column:
    """Keys of the anchors of one half: its own, or with ``near`` all within two bits."""
    bits = _half(value, half)
    masks = [m if near else m[:1] for m in _masks()]
    table = F.array(*[F.array(*map(F.lit, m)) for m in masks]).cast("array<array<bigint>>")
    return F.transform(F.element_at(table, _syndrome(bits).cast("int") + 1),
                       lambda m: bits.bitwiseXOR(m) + F.lit(half << 31))


def links(values: DataFrame) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` that differ in at most two bits."""
    spread = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # narrow rows
    filed = materialize(values.select("fp", F.explode(F.concat(
        anchors(F.col("fp"), 0, False), anchors(F.col("fp"), 1, False))).alias("anchor")), "filed")
    asked = spread.select(F.col("fp").alias("a"), F.explode(F.concat(
        anchors(F.col("fp"), 0, True), anchors(F.col("fp"), 1, True))).alias("anchor"))
    met = asked.join(filed.withColumnRenamed("fp", "b").hint("merge"), "anchor").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS))
    return met.select("a", "b").distinct()


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id, group_size and the row keys."""
    seen = materialize(docs.select(
        docs[id_column].cast("long").alias("doc_id"), *row_keys(docs, id_column, text_column),
        fingerprints(text_of(docs, text_column)).alias("fp")), "fingerprints")
    values = materialize(seen.groupBy("fp").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "values")
    labels = component_labels(links(values), [], "a", "b")
    joined = materialize(values.join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "first_id", "rows", F.coalesce("component", "fp").alias("component")), "labelled")
    totals = materialize(joined.groupBy("component").agg(
        F.min("first_id").alias("component_id"), F.sum("rows").alias("group_size")), "totals")
    classes = materialize(joined.select("fp", "component").join(totals.hint("merge"), "component"), "classes")
    return seen.join(classes.hint("merge"), "fp").select(
        "doc_id", "_rid", "_rhash", "fp", "component_id", "group_size", "component")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, a null one last."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"),
                     F.col("_rhash").alias("h"), F.col("_rid").alias("i"))
    kept = components(docs, id_column, text_column).groupBy("component").agg(F.min(order).alias("k"))
    return apply_kept(docs, kept.select(F.col("k.i").alias("_rid"), F.col("k.h").alias("_rhash")),
                      id_column, text_column)
