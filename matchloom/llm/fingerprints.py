"""Document fingerprints by context-triggered piecewise hashing (operator 13).

A rolling hash over the last 7 bytes ends a chunk wherever it is one less than a multiple of the block size, so
chunk borders depend on their context alone and move with the text. Block sizes are 1, 3, 6, 12 and on,
doubling; the borders of a size are borders of every smaller one. A text takes the largest size that gives at
least ``LEAST_CHUNKS`` borders, and its fingerprint is ``size:chunks:chunks at the next size``, two letters a chunk.
Fingerprints are compared by edit distance (insertions and deletions) over chunks, where both have a signature
of the same block size: the likeness is twice the longest common subsequence over all chunks, 0 to 1, and 0 where
no size is shared. Whole texts are read: beyond ``MOST_CHUNKS`` chunks the last one holds all the rest.

How it runs. Fingerprints alone are a projection. To compare each document with the one that follows it by id,
documents are range-sorted once; a task walks its range, a bounded stretch of documents at a time, and the first
and last document of each range, two rows a task, meet in a small join. Hashing is arithmetic over flat
arrays of many documents; only chunks, not bytes, are handled one by one.

Defined cases: a null text counts as empty, and an empty text has the fingerprint ``1::``, which is like itself (1)
and unlike any other (0); a null id comes last, equal ids are ordered by text; the last document is followed by the
first, a single one by itself; repeated rows are documents of their own, and as the sort also has a row
number, a third of all rows may be equal; extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import picked
from matchloom.session import materialize

WINDOW = 7
LEAST_CHUNKS, MOST_CHUNKS = 32, 128
LEVELS = 34
STRETCH_CHARS = 2_000_000  # characters hashed together, or one document
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
RESULT_ROW, FIRST, LAST = 0, 1, 2


def block_size(level: int) -> int:
    return 3 << level - 1 if level else 1


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last ``WINDOW`` bytes at each place but the first ``WINDOW`` - 1."""
    n = len(data) - WINDOW + 1
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for j in range(WINDOW):
        byte = data[WINDOW - 1 - j:WINDOW - 1 - j + n].astype(np.uint32)
        total += byte
        weighted += byte * np.uint32(WINDOW - j)
        if 5 * j < 32:
            shifted ^= byte << np.uint32(5 * j)
    return total + weighted + shifted


def _signature(ends: np.ndarray, owner: np.ndarray, first: np.ndarray, sums: np.ndarray) -> list[str]:
    """Letters of each document's chunks, which end at the rising places ``ends``."""
    docs = len(first) - 1
    counts = np.bincount(owner, minlength=docs)
    nth = np.arange(len(ends)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    kept = (nth < MOST_CHUNKS - 1) | last
    ends, owner, nth = ends[kept], owner[kept], nth[kept]
    starts = np.where(nth == 0, first[owner], np.append(0, ends[:-1]) if len(ends) else ends)
    value = (sums[ends] - sums[starts]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
    letters = np.frombuffer(LETTERS.encode(), np.uint8)
    text = np.stack([letters[value >> np.uint64(6)], letters[value & np.uint64(63)]], 1).tobytes().decode()
    at = np.append(0, np.cumsum(np.bincount(owner, minlength=docs))) * 2
    return [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    gap = bytes(WINDOW - 1)
    coded = [t.encode() for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    if not sizes.sum():
        return ["1::"] * len(texts)
    data = np.frombuffer(gap + gap.join(coded) + gap, np.uint8)
    # place i of the hash belongs to byte i + WINDOW - 1 of the data: documents start at ``first``
    first = np.append(0, np.cumsum(sizes + len(gap)))
    h = rolling(data)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + len(gap))[:len(h)]
    mixed = h.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    v = h + np.uint32(1)
    at = np.flatnonzero(v % np.uint32(3) == 0)
    at = at[at - first[owner[at]] < sizes[owner[at]]]
    zeros = v[at] & (~v[at] + np.uint32(1))  # the lowest bit that is set
    level = np.where(zeros == 0, LEVELS - 2, np.log2(np.maximum(zeros, 1)).astype(np.int64)) + 1
    of = owner[at].astype(np.int64)
    counts = np.bincount(of * LEVELS + level, minlength=len(texts) * LEVELS).reshape(-1, LEVELS)
    borders = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
    borders[:, 0] = sizes
    enough = borders >= LEAST_CHUNKS
    taken = np.where(enough.any(1), LEVELS - 1 - np.argmax(enough[:, ::-1], 1), 0)
    out = []
    for above in (0, 1):
        ends = at[level >= taken[of] + above] + 1
        if above == 0 and (taken == 0).any():
            every = np.flatnonzero(taken[owner] == 0)
            ends = np.concatenate([ends, every[every - first[owner[every]] < sizes[owner[every]]] + 1])
        ends = np.unique(np.concatenate([ends, (first[:-1] + sizes)[sizes > 0]]))
        out.append(_signature(ends, owner[ends - 1].astype(np.int64), first, sums))
    return [f"{block_size(k)}:{a}:{b}" for k, a, b in zip(taken.tolist(), *out)]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a column of the table per machine word operation."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for x in b:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & whole
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (p, a0, a1), (q, b0, b1) = a.split(":"), b.split(":")
    sizes = [block_size(k) for k in range(LEVELS + 1)]
    i, j = sizes.index(int(p)), sizes.index(int(q))
    if abs(i - j) > 1:
        return 0.0
    x, y = (a0, b0) if i == j else (a0, b1) if i > j else (a1, b0)
    x, y = ([s[k:k + 2] for k in range(0, len(s), 2)] for s in (x, y))
    return 2.0 * common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint."""
    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        out, held, chars = [], [], 0
        for t in texts:
            held.append(t)
            chars += len(t)
            if chars >= STRETCH_CHARS:
                out += fingerprints_of(held)
                held, chars = [], 0
        return pd.Series(out + (fingerprints_of(held) if held else []), dtype=object)

    plain = picked(docs, doc_id=id_column, text=text_column)
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"),
                        fingerprint(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the front of the following one."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def compared(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Rows of ``RESULT``; ``following`` is ``texts`` moved up by one, with one more, or any texts."""
    changed = [edited(t, n) for t, n in zip(texts, following)]
    shared = all(a is b for a, b in zip(texts[1:], following))
    own = fingerprints_of(texts + following[-1:] if shared else texts + following)
    own, then = own[:len(texts)], own[1:] if shared else own[len(texts):]
    new = fingerprints_of(changed)
    return [(i, len(t), hashlib.sha256(c.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, n))
            for i, t, c, f, e, n in zip(ids, texts, changed, own, new, then)]


def compared_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document by id (columns of ``RESULT``)."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    plain = picked(docs, doc_id=id_column, text=text_column)
    plain = plain.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_row")]
    ranges = plain.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(
        *order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # null ids stay whole in pandas

    def rows_of(kind: int, part: int, rows: list[tuple], text: str | None = None) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        return out.assign(part=part, kind=kind, text=pd.Series([text] * len(out), dtype=object))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, texts, chars, begun = TaskContext.get().partitionId(), [], [], 0, False
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if doc_id is None else int(doc_id)
                if not begun:
                    yield rows_of(FIRST, part, [(doc_id, *[None] * (len(names) - 1))], text)
                    begun = True
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if chars >= STRETCH_CHARS and len(ids) > 1:
                    yield rows_of(RESULT_ROW, part, compared(ids[:-1], texts[:-1], texts[1:]))
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield rows_of(RESULT_ROW, part, compared(ids[:-1], texts[:-1], texts[1:]))
        if ids:
            yield rows_of(LAST, part, [(ids[-1], *[None] * (len(names) - 1))], texts[-1])

    walked = materialize(ranges.mapInPandas(walk, f"{RESULT}, part int, kind int, text string"), "fingerprints")
    first = walked.filter(F.col("kind") == FIRST).select("part", F.col("text").alias("following"))
    last = walked.filter(F.col("kind") == LAST).select("part", F.col("doc_id").cast("string").alias("doc_id"), "text")
    # one row per task: which range comes next; the last is followed by the first
    every = Window.orderBy("part")
    parts = first.select("part").select("part", F.coalesce(
        F.lead("part").over(every), F.first("part").over(every)).alias("then"))
    pairs = last.join(parts, "part").join(first.withColumnRenamed("part", "then"), "then")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for i, t, n in zip(batch["doc_id"], batch["text"], batch["following"])
                    for row in compared([None if i is None else int(i)], [t], [n])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    ends = pairs.select("doc_id", "text", "following").mapInPandas(meet, RESULT)
    return walked.filter(F.col("kind") == RESULT_ROW).select(*names).unionByName(ends)
