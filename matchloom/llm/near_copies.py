"""Near copies at a shingle similarity of 0.8, by SimHash and anchor-point covering (operator 5 for pipelines).

Two fingerprints of 2,048 bits are taken of each text. The one for search is made of its distinct 2-word
shingles: a replaced word changes two of those, so near copies differ in few bits. The one for the decision is
made of its distinct 5-word shingles. Both are signs of random projections: every shingle adds four signed ones
to a vector of 2,048 counts, which a Walsh-Hadamard transform turns into 2,048 sums; their signs are the bits.

The search fingerprint is cut into 64 parts of 32 bits, of which 31 count. The code words of the Hamming code
[31, 26] cover a part with radius 1 and are its anchors. With 64 parts a fingerprint that differs in fewer than
64 bits has a part without a difference, so the threshold within a part is zero and each fingerprint is filed at
the one anchor within the covering radius of every part: 64 narrow rows per distinct text. Texts that meet at an
anchor are compared by the 5-word fingerprint: at most ``MOST_BITS`` of 2,048 bits differ at a similarity of 0.8.

No anchor forms pairs within its group. In each round one text of the group, the first in an order drawn anew,
is compared with the others; texts linked to an earlier one leave the search, the rest meet again, until a round
links nothing more. This search works by likelihood, as similarity is estimated to about 0.02 and a pair may meet
at no anchor.

What it leaves out is found exactly. Of two texts at a similarity of 0.8 or more, each has one of the first fifth
of its distinct 5-word shingles (and one more) in common with the other's first fifth, whatever order all texts share.
The order puts rare shingles first, as told by a bounded sample; it decides how many pairs are looked at, never which
links are found. Texts that share such a shingle and are in different groups so far are compared by an odd sketch
first: one bit for each of 2,048 places, set if an odd number of the shingles fall there. At a place that differs at least
one shingle is in one of the texts only, so a pair with more such places than 0.8 allows is no link. Of the others, which
are few, the sets of shingle hashes are compared; only those sets are made. Groups are the components over all links: no
pair at 0.8 or more is left in two groups.

Defined cases. Words are those between ASCII white space, A-Z in lower case; texts of fewer words than a shingle
are one shingle; texts of equal words are copies, texts without words (null, empty, blank) too. A null
doc_id is kept only in groups without another. Rows equal in id and text appear once. Extra columns are returned
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import apply_kept, picked, row_keys, text_of
from matchloom.operators.components import component_labels
from matchloom.session import materialize

BITS = 2048
PARTS = 64
SEARCH_SHINGLE = 2
SHINGLE = 5
#: angle between sets of equal size at Jaccard 0.8 is arccos(1.6 / 1.8); its share of pi is the share of bits
MOST_BITS = int(BITS * np.arccos(1.6 / 1.8) / np.pi)
SIGNS = 4
BATCH = 256
SAMPLE, COMMON = 8192, 100_000  # texts that tell which shingles are common, shingles told
SCHEMA = "words binary, anchors array<int>, bits array<long>, size int, prefix array<long>, odd array<long>"

_PLACES = np.arange(1, 32)
_CHECKS = np.array([_PLACES >> k & 1 for k in range(5)], np.int32).T  # which parity checks a bit is in
_INFO = np.flatnonzero(_PLACES & (_PLACES - 1))  # bits that are no check bits


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of a text's distinct shingles."""
    if len(words) < size:
        distinct = {b" ".join(words)} if words else set()
    else:
        distinct = set(map(b" ".join, zip(*[words[i:] for i in range(size)])))
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)


def counts(hashes: np.ndarray) -> np.ndarray:
    """The vector of a text's distinct shingles: each adds four signed ones at places drawn by its hash."""
    place = np.concatenate([hashes >> 12 * k & BITS - 1 for k in range(SIGNS)])
    sign = np.concatenate([(hashes >> 12 * k + 11 & 1) * 2.0 - 1 for k in range(SIGNS)])
    return np.bincount(place, sign, BITS).astype(np.int32)


def prefix(keys: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first of a text's shingles ``keys`` by (times seen in the sample, hash): any set of 0.8 similarity has one of them
    among its own first ones, as at least four fifths of either set are shared."""
    seen = np.zeros(len(keys), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        seen = np.where(common[at] == keys, times[at], 0)
    return keys[np.lexsort((keys, seen))[:len(keys) - (4 * len(keys) + 4) // 5 + 1]]


def odd_places(keys: np.ndarray) -> np.ndarray:
    """The odd sketch of a text's shingles ``keys``."""
    return np.packbits(np.bincount(keys & BITS - 1, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def fingerprint_bits(vectors: np.ndarray) -> np.ndarray:
    """Signs of the Walsh-Hadamard transform of each row, exact as the counts are whole."""
    sums, step = vectors, 1
    while step < BITS:
        pairs = sums.reshape(len(sums), -1, 2, step)
        sums = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        step *= 2
    return (sums.reshape(-1, BITS) > 0).astype(np.uint8)


def anchors(bits: np.ndarray) -> np.ndarray:
    """The anchor of each part of each row, with the number of the part in front."""
    parts = bits.reshape(len(bits), PARTS, -1)[:, :, :31].copy()
    wrong = (parts @ _CHECKS & 1) @ (1 << np.arange(5))
    row, part = np.nonzero(wrong)
    parts[row, part, wrong[row, part] - 1] ^= 1
    word = parts[:, :, _INFO].astype(np.int64) @ (1 << np.arange(len(_INFO)))
    return (word | np.arange(PARTS) << len(_INFO)).astype(np.uint32).view(np.int32)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def common_shingles(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen more than twice in about ``SAMPLE`` texts, the ``COMMON`` most frequent at most, and how often."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"shingle": np.unique(shingles(_words(text), SHINGLE))})

    named = picked(docs, doc_id=id_column, text=text_column)
    plain = named.select("doc_id", text_of(named).alias("text"))
    every = max(1, plain.count() // SAMPLE)
    some = plain.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").mapInPandas(
        each, "shingle long")
    told = some.groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    found = np.array(sorted((r[0], r[1]) for r in told), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", common=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row keys, digest of the words, anchors and 5-word fingerprint, number of
    distinct 5-word shingles, the first of them in the order that ``common`` gives, and their odd sketch."""
    known, times = common or (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def some(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(texts), BATCH):
            search, decide, digests, firsts = [], [], [], []
            for text in texts.iloc[at:at + BATCH]:  # the words of one text at a time
                words = _words(text)
                search.append(counts(shingles(words, SEARCH_SHINGLE)))
                hashes = shingles(words, SHINGLE)
                decide.append(counts(hashes))
                digests.append(xxhash.xxh128_digest(b" ".join(words)))
                keys = np.unique(hashes)
                firsts.append((len(keys), prefix(keys, known, times), odd_places(keys)))
            packed = np.packbits(fingerprint_bits(np.stack(decide)), axis=1).view(np.int64)
            rows += [(*row, *first) for *row, first in zip(digests, anchors(fingerprint_bits(np.stack(search))), packed, firsts)]
        return pd.DataFrame(rows, columns=["words", "anchors", "bits", "size", "prefix", "odd"])

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from map(some, batches)

    plain = picked(docs, doc_id=id_column, text=text_column)
    made = F.pandas_udf(compute, SCHEMA)(text_of(plain))
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(plain), made.alias("of")).select(
        "doc_id", "_rid", "_rhash", "of.*")


def _differing(a: str, b: str) -> Column:
    """Number of bits that differ between two columns of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between distinct texts (words, anchors, bits), found in rounds."""
    marks = materialize(texts.select("words", "bits"), "marks")
    filed = texts.select("words", F.explode("anchors").alias("anchor"))
    shared = filed.groupBy("anchor").count().filter("count > 1").select("anchor")
    met = materialize(filed.join(shared, "anchor"), "met")  # most anchors hold one text
    found = None
    for number in range(1 << 30):
        order = F.struct(F.xxhash64(F.lit(number), "words"), "words")
        first = met.groupBy("anchor").agg(F.min(order)["words"].alias("a"))
        asked = met.join(first, "anchor").filter("words != a").select("a", F.col("words").alias("b")).distinct()
        one = marks.select(F.col("words").alias("a"), F.col("bits").alias("a_bits"))
        two = marks.select(F.col("words").alias("b"), F.col("bits").alias("b_bits"))
        new = materialize(asked.join(two, "b").join(one, "a").filter(_differing("a_bits", "b_bits") <= MOST_BITS).select(
            "a", "b"), "links")
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else found.unionByName(new)
        left = new.select(F.col("b").alias("words")).distinct()
        met = materialize(met.join(left, "words", "left_anti"), "met")


def _shared(rows: DataFrame, of: str) -> DataFrame:
    """Rows whose ``key`` comes with more than one ``of``."""
    several = rows.groupBy("key").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).filter("lo != hi").select("key")
    return rows.join(several, "key")


def links_left(docs: DataFrame, seen: DataFrame, groups: DataFrame, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """Links (a, b) between ``groups`` (words, k, group) with texts at a similarity of 0.8 or more, all of them.

    ``seen``: words, size, prefix and odd sketch of the texts; ``k`` has the row keys of one row of ``docs`` with these words.
    """
    tag = F.xxhash64("words").alias("tag")  # narrower than the digest
    filed = seen.select(tag, "size", F.posexplode("prefix").alias("at", "key")).repartition("key")
    met = materialize(_shared(filed, "tag"), "shared")  # most shingles are in one text
    placed = met.join(groups.select(tag, "words", "group"), "tag").select("key", "at", "size", "words", "group").distinct()
    placed = materialize(_shared(placed, "group"), "placed")

    def side(x: str) -> DataFrame:
        return placed.select("key", F.col("at").alias(f"{x}_at"), F.col("size").alias(f"{x}_size"),
                             F.col("words").alias(x), F.col("group").alias(f"{x}_group"))

    def enough(both: Column) -> Column:  # of a + b - both distinct shingles
        return 9 * both >= 4 * (F.col("a_size") + F.col("b_size"))

    # shingles shared up to the last one met are counted, after it no more can be than the shorter rest has
    after = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))  # with the one met
    asked = side("a").join(side("b"), "key").filter((F.col("a_group") < F.col("b_group")) & enough(
        F.least("a_at", "b_at") + after)).groupBy("a", "b", "a_group", "b_group", "a_size", "b_size").agg(
        F.count(F.lit(1)).alias("n"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
    asked = asked.filter(enough(F.col("n") - 1 + after)).select("a", "b", "a_group", "b_group", "a_size", "b_size")
    odd = seen.select("words", "odd").dropDuplicates(["words"])
    asked = asked.join(odd.toDF("a", "a_odd"), "a").join(odd.toDF("b", "b_odd"), "b")
    # what the texts do not share is at least what differs in the sketches
    asked = materialize(asked.filter(9 * _differing("a_odd", "b_odd") <= F.col("a_size") + F.col("b_size")).drop(
        "a_odd", "b_odd"), "asked")
    wanted = materialize(asked.select(F.col("a").alias("words")).union(asked.select("b")).distinct().join(
        groups, "words").select("words", F.col("k.i").alias("_rid"), F.col("k.h").alias("_rhash")), "wanted")

    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(_words(t), SHINGLE)) for t in texts], dtype=object)

    plain = picked(docs, doc_id=id_column, text=text_column)
    rows = plain.select(*row_keys(plain), text_of(plain).alias("text")).join(wanted, ["_rid", "_rhash"])
    made = F.pandas_udf(hashes, "array<long>")
    sets = materialize(rows.dropDuplicates(["words"]).select("words", made("text").alias("set")), "sets")
    compared = asked.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
    return compared.filter(enough(F.size(F.array_intersect("a_set", "b_set")))).select(
        F.col("a_group").alias("a"), F.col("b_group").alias("b")).distinct()


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies in ``docs``: that with the smallest doc_id, a null one last."""
    common = common_shingles(docs, id_column, text_column)
    seen = materialize(described(docs, id_column, text_column, common), "described")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"),
                    F.col("_rhash").alias("h"), F.col("_rid").alias("i"))
    firsts = materialize(seen.groupBy("words").agg(
        F.min(rank).alias("k"), F.first("anchors").alias("anchors"), F.first("bits").alias("bits")), "texts")
    labels = component_labels(links(firsts.select("words", "anchors", "bits")), [], "a", "b")
    groups = materialize(firsts.select("words", "k").join(labels.withColumnRenamed("node", "words"), "words", "left").select(
        "words", "k", F.coalesce("component", "words").alias("group")), "groups")
    more = component_labels(links_left(docs, seen, groups, id_column, text_column), [], "a", "b")
    grouped = groups.join(more.withColumnRenamed("node", "group"), "group", "left")
    kept = grouped.groupBy(F.coalesce("component", "group").alias("group")).agg(F.min("k").alias("k"))
    return apply_kept(docs, kept.select(F.col("k.i").alias("_rid"), F.col("k.h").alias("_rhash")),
                      id_column, text_column)
