"""Periodic runs of words, found in tiles that grow with the period (operator 11).

A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` and two periods long, that no
neighbouring word extends. Periods are taken by octaves. Those below ``LOW`` share one kind of tile: a stretch
of a document that overlaps the next by two periods, whose Z-values are taken offset by offset for all
boundaries at once. Octave k above (periods from 2^k to 2^(k+1) - 1) has a boundary at every
multiple of 2^k, which any of its runs must cross, and around each boundary a tile that reaches 2^(k+1) words
back and 2^(k+2) on. Two Z-functions, forward from the boundary and backward before it, give for each
period how far the words around the boundary repeat; where the two make up a period, that is a fragment of a
run. A fragment that also has a shorter period dividing its own is left to that one.

How it runs. One pass over the documents explodes each into tiles. Tiles of the octaves are made only where
the 16 words after or before a boundary come again within the octave's distance, which every run of 64 words a
period must satisfy; so plain prose makes none. Tiles of documents of up to ``LONG_WORDS`` words are solved
where they are made, those of longer ones are dealt to all tasks. Fragments, two numbers and a
period each, are shuffled by document and period and stitched where they overlap by a period. Text is shuffled
only for documents that have fragments, to be collapsed. A task holds about ``CHUNK_WORDS`` words, or
one document, or one tile.

Defined cases: null and empty texts have no words and no runs; documents of any length are read whole; a row is
a document, so repeated rows and null ids each get a result; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import picked
from matchloom.session import materialize

LEAST_WORDS = 12
LOW_OCTAVE = 6
LOW = 1 << LOW_OCTAVE  # periods below are read offset by offset
GRAM = 16
LONG_WORDS = 4096
CHUNK_WORDS = 1_000_000
DOCUMENT, FRAGMENT, TILE = 0, 1, 2
ROWS = ("row long, kind int, doc_id long, n_words long, text string, words_sha256 string, octave int, "
        "place long, left long, ids binary, period long, start long, end long")
FRAGMENTS = "row long, period long, start long, end long"


def z_values(s: list[int], upto: int) -> list[int]:
    """How far ``s`` agrees with itself from each of the places 1 to ``upto`` - 1 on."""
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i], left, right = k, i, i + k
    return z


def low_fragments(ids: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, end) of stretches with periods below ``LOW``.

    ``owner`` tells the documents in ``ids`` apart; a word that occurs nowhere else stands between them.
    """
    found = []
    for p in range(1, min(LOW, len(ids) // 2 + 1)):
        at = np.flatnonzero(ids[:-p] == ids[p:])
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        starts = at[first]
        lengths = np.diff(first, append=len(at))
        good = lengths >= max(p, LEAST_WORDS - p)
        if owner is not None:
            good &= owner[starts] == owner[starts + p]
        starts, lengths = starts[good], lengths[good]
        if len(starts):
            found.append((np.full(len(starts), p, np.int64), starts, starts + lengths + p))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def grams_that_return(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``GRAM`` words that stand more than once in a document, and their sorted (gram, place) keys.

    Grams are told apart by 64-bit hashes: two that share one only make a tile without a run.
    """
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(0xBF58476D1CE4E5B9, step, 1 << 64)) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (h + owner[:len(h)].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.append(same, False) | np.append(False, same)
    gram = np.cumsum(np.append(False, ~same))[again]
    place = order[again]
    return place, gram * (2 * n) + place


def boundaries(ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """(octave, document, boundary in the document) of all tiles that may hold a run."""
    n = len(ids)
    place, key = grams_that_return(ids, owner)
    if not len(place):
        return
    inside = place - starts[owner[place]]
    octave = LOW_OCTAVE
    while 2 << octave <= sizes.max():
        width = 1 << octave
        found = []
        for shift in (0, GRAM):
            at = (inside + shift) % width == 0
            base = key[at]
            then = np.searchsorted(key, base + width)
            hit = then < len(key)
            hit[hit] = key[then[hit]] < base[hit] + 2 * width
            found.append(place[at][hit] + shift)
        # the words before a boundary may be the last of a document
        for b in np.unique(np.concatenate(found)).tolist():
            if b < n and b - starts[owner[b]] < sizes[owner[b]]:
                yield octave, int(owner[b]), int(b - starts[owner[b]])
        octave += 1


def tile_of(octave: int, boundary: int, size: int) -> tuple[int, int]:
    """First word and end of a boundary's tile."""
    return max(0, boundary - (2 << octave)), min(size, boundary + (4 << octave))


def tile_fragments(ids: list[int], left: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) in a tile around the boundary ``left``."""
    low, reach = 1 << octave, 2 << octave
    high = min(reach, len(ids) - left)
    if high <= low:
        return []
    ahead = z_values(ids[left:], high)
    back = ids[:left][::-1]
    joined = back + [None] + ids[:left + high - 1][::-1]
    behind = [0] * high
    if back:
        z = z_values(joined, len(joined))
        for p in range(1, high):
            behind[p] = z[left + high - p]
    found = []
    for p in range(low, high):
        on = min(ahead[p], reach)
        if not on or on + behind[p] < p:
            continue
        if not any(ahead[d] >= p + on - d and behind[d] >= behind[p] for d in shorter_periods(p)):
            found.append((p, left - behind[p], left + p + on))
    return found


def shorter_periods(p: int) -> list[int]:
    """``p`` divided by each of its primes."""
    out, rest, f = [], p, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(p // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return out + [p // rest] if rest > 1 else out


def exploded(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Rows of three kinds: documents, fragments of tiles solved here, and tiles to be solved."""
    def rows_of(data: list[tuple[int, object, str, list[bytes]]]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        sizes = np.array([len(d[3]) for d in data], np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        ids = np.empty(int((sizes + 1).sum()), np.int32)
        for d, (_, _, _, words) in enumerate(data):
            ids[starts[d]:starts[d] + sizes[d]] = [known.setdefault(w, len(known)) for w in words]
            ids[starts[d] + sizes[d]] = -1 - d
        owner = np.repeat(np.arange(len(data)), sizes + 1)
        row = np.array([d[0] for d in data], np.int64)
        found, tiles = [], []
        whole = sizes <= long_words
        if whole.all():
            p, s, e = low_fragments(ids, owner)
        else:
            kept = np.flatnonzero(whole[owner])
            p, s, e = low_fragments(ids[kept], owner[kept])
            s, e = kept[s], kept[e - 1] + 1
            for d in np.flatnonzero(~whole).tolist():
                for at in range(0, int(sizes[d]), long_words):
                    end = min(at + long_words + 2 * LOW, int(sizes[d]))
                    tiles.append((row[d], 0, at, 0, ids[starts[d] + at:starts[d] + end].tobytes()))
        d = owner[s]
        found.append(np.stack([row[d], p, s - starts[d], e - starts[d]], 1))
        more = []
        for octave, d, b in boundaries(ids, owner, starts, sizes):
            first, end = tile_of(octave, b, int(sizes[d]))
            tile = ids[starts[d] + first:starts[d] + end]
            if whole[d]:
                more += [(row[d], p, first + s, first + e) for p, s, e in tile_fragments(tile.tolist(), b - first, octave)]
            else:
                tiles.append((row[d], octave, first, b - first, tile.tobytes()))
        if more:
            found.append(np.array(more, np.int64))
        fragments = pd.DataFrame(np.concatenate(found), columns=["row", "period", "start", "end"])
        touched = set(fragments["row"].tolist()) | {t[0] for t in tiles}
        yield shaped(pd.DataFrame({
            "row": row, "doc_id": pd.array([d[1] for d in data], "Int64"), "n_words": sizes,
            "text": [d[2] if d[0] in touched else None for d in data],
            "words_sha256": [hashlib.sha256(b" ".join(d[3])).hexdigest() for d in data]}), DOCUMENT)
        for at in range(0, len(fragments), 100_000):
            yield shaped(fragments.iloc[at:at + 100_000], FRAGMENT)
        for at in range(0, len(tiles), 16):
            yield shaped(pd.DataFrame(tiles[at:at + 16], columns=["row", "octave", "place", "left", "ids"]), TILE)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, data, n = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = text.encode().split()
                data.append((number, None if doc_id is None else int(doc_id), text, words))
                number += 1
                n += len(words) + 1
                if n >= CHUNK_WORDS:
                    yield from rows_of(data)
                    data, n = [], 0
        if data:
            yield from rows_of(data)

    return materialize(docs.mapInPandas(explode, ROWS), "run-tiles")


def shaped(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
    """The rows with all columns, null where the kind has none."""
    types = {c.split()[0]: {"long": "Int64", "int": "Int32"}.get(c.split()[1], object) for c in ROWS.split(", ")}
    return rows.assign(kind=kind).reindex(columns=list(types)).astype(types)


def solved(tiles: DataFrame) -> DataFrame:
    """Fragments of the tiles, each solved on its own."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row, octave, place, left, ids in zip(*(batch[c] for c in ("row", "octave", "place", "left", "ids"))):
                words = np.frombuffer(ids, np.int32)
                some = (zip(*(x.tolist() for x in low_fragments(words))) if octave == 0
                        else tile_fragments(words.tolist(), int(left), int(octave)))
                found += [(row, p, place + s, place + e) for p, s, e in some]
            yield pd.DataFrame(found, columns=["row", "period", "start", "end"], dtype="int64")

    dealt = tiles.select("row", "octave", "place", "left", "ids")
    return dealt.repartition("row", "octave", "place").mapInPandas(solve, FRAGMENTS)


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (row, start, end, period) of fragments that overlap by a period."""
    ordered = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0)
    pieces = fragments.withColumn("_opens", opens).withColumn(
        "_run", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = pieces.groupBy("row", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST_WORDS), 2 * F.col("period"))).select(
        "row", "start", "end", "period")


def collapsed_text() -> Column:
    """The words no run contains after its first period, joined by one space; null without a run."""
    @F.pandas_udf("string")
    def collapse(texts: pd.Series, starts: pd.Series, ends: pd.Series, periods: pd.Series) -> pd.Series:
        out = []
        for text, s, e, p in zip(texts, starts, ends, periods):
            if text is None or s is None or not len(s):
                out.append(None)
                continue
            words = text.encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, np.asarray(s) + np.asarray(p), 1)
            np.add.at(change, np.asarray(e), -1)
            keep = np.cumsum(change)[:-1] == 0
            out.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode())
        return pd.Series(out, dtype=object)

    return collapse("text", "_runs.start", "_runs.end", "_runs.period")


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              long_words: int = LONG_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed, words_sha256.

    ``runs`` is an array of (start, length, period) by start, then period; ``collapsed`` is the text without
    the words that repeat in a run, null where no run is; ``words_sha256`` is the digest of all words joined by
    one space.
    """
    plain = picked(docs, doc_id=id_column, text=text_column)
    plain = plain.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"),  # null ids stay whole in pandas
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = exploded(plain, long_words)
    here = rows.filter(F.col("kind") == FRAGMENT).select("row", "period", "start", "end")
    fragments = here.unionByName(solved(rows.filter(F.col("kind") == TILE)))
    runs = stitched(fragments).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "period"))).alias("_all"))
    # of stretches with the same ends the one with the smallest period comes first: it is the run
    runs = runs.select("row", F.expr(
        "filter(_all, (r, i) -> i = 0 or r.start <> _all[i - 1].start or r.end <> _all[i - 1].end)").alias("_runs"))
    # by start, then period, while the array is by start, then end
    shown = F.array_sort(F.transform("_runs", lambda r: F.struct(
        r["start"].alias("start"), r["period"].alias("period"), (r["end"] - r["start"]).alias("length"))))
    shown = F.transform(shown, lambda r: F.struct(r["start"], r["length"], r["period"]))
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    found = rows.filter(F.col("kind") == DOCUMENT).select("row", "doc_id", "n_words", "text", "words_sha256").join(
        runs, "row", "left")
    return found.select("doc_id", "n_words", F.coalesce(shown, none).alias("runs"),
                        collapsed_text().alias("collapsed"), "words_sha256")


def with_planted_periods(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by id, the words repeat from some word on.

    With h the crc32 of the id's decimal text and g = floor(h / 10), a document with h % 10 = 0 and n > 0 words has
    from word a = g % n on the words at a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    plain = picked(docs, doc_id=id_column, text=text_column).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = plain.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    chosen = chosen.withColumn("_n", F.size("_w")).withColumn("_g", F.floor(F.col("_h") / 10).cast("long"))
    return chosen.withColumn("text", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.expr(
        "array_join(concat(slice(_w, 1, int(_g % _n)), slice(flatten(array_repeat(slice(_w, int(_g % _n) + 1, "
        "1 + int((_n - _g % _n) div (3 + _g % 8))), int(4 + _g % 8))), 1, int(_n - _g % _n))), ' ')")
    ).otherwise(F.col("text"))).select("doc_id", "text")
