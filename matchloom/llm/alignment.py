"""Alignment of two tokenizers' tokens over whole texts (operator 12).

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with byte fallback) the text, to which it
adds that space itself. Byte offsets where tokens of both end cut the two sequences into groups; every
token of A in a group is linked to every token of B in it. The count of an id pair is the number of documents of
the corpus that hold it linked.

Identity map: for each id of A the id of B with the same bytes is computed beforehand. Pairs of that map, which are
nearly all exact one-to-one groups, are counted in a vector as long as A's vocabulary, which a task sends once.
Only the other pairs, those of irregular groups, enter the shuffle by pair.

How it runs. A text is cut into units before each run of spaces that follows a visible character: neither tokenizer
has a token across such a place, so a unit's tokens and groups do not depend on the rest, and each distinct
unit is tokenized once per worker. One pass over the documents writes blocks: documents as numbers of
units, units as links, links as numbers of pairs, and, per block, how many documents hold each pair. Counts of the
irregular pairs are summed over all blocks and joined back by (a, b); with them a block adds up what its
documents ask for. The two vectors that go to every task are as long as A's vocabulary. In a very long group
equal ids are taken together, so a group costs its distinct pairs, not its square. If a vocabulary has a piece across
units, or the bytes of a unit come back changed, the whole text is one unit.

Defined cases: null and empty texts, and texts whose joined tokens of either side differ from a space and the text (a
U+2581 in it, say), have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Repeated rows
count as documents each; a null id stays null; extra columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import picked
from matchloom.session import materialize

CUT = re.compile(r"(?<=\S)(?= )")
WIDE = 4096  # pairs of a group beyond which equal ids are taken together
BLOCK_UNITS = 200_000  # units of a block, or one document
SLICE_CHARS = 1_000_000  # characters whose units are learned together, or one document
MOST_UNITS, MOST_CHARS = 200_000, 32_000_000  # units a worker remembers
BLOCK_PARTS = ("ids", "n_a", "n_b", "n_groups", "n_links", "digest", "length", "seq", "links", "pair", "times", "pair_a")
ROWS = ("kind int, block long, place int, a long, b long, n long, " + ", ".join(f"{p} binary" for p in BLOCK_PARTS))
BLOCK, PAIR, SAME = 0, 1, 2
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


class Ragged:
    """Rows of numbers of unequal length that grow in a flat array."""

    def __init__(self, kind):
        self.flat, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given rows, one after the other, and how many each has."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        return self.flat[spans(self.ends[rows], sizes)], sizes


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches of these sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def byte_level() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: visible Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in kept}
    return letters | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        same: dict[bytes, int] = {}
        for i, data in enumerate(self.bytes_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (data not in same or self.b.is_byte(same[data])):
                same[data] = i
        self.same = np.array([same.get(data, -1) if data else -1 for data in self.bytes_a], np.int64)
        self.names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def each(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units one by one; each begins with the space that B adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [ids if ids or u != " " else [self.space] for ids, u in zip(b, units)]

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that follow each other as one text, or None if bytes come back changed."""
        texts = ["".join(units[i:i + 500]) for i in range(0, len(units), 500)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in self.each(texts))
        data = "".join(texts).encode()
        return (a, b) if self.joined(self.bytes_a, a) == data == self.joined(self.bytes_b, b) else None

    @staticmethod
    def joined(known: list[bytes], ids: np.ndarray) -> bytes:
        return b"".join([known[i] for i in ids.tolist()])


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(path_a, path_b)


class Units:
    """What is known of each distinct unit: numbers of tokens, groups and links, its links, its groups as text."""

    def __init__(self, pair: Tokenizers):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.used = np.zeros(0, np.int64)
        self.text: list[bytes] = []
        self.wrong: set[str] = set()  # their bytes come back changed
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.links, self.times = Ragged(np.int64), Ragged(np.int64)  # a << 32 | b, and how often

    def forget(self) -> None:
        """Keep the units met most often, at most half of ``MOST_UNITS``, under new numbers."""
        kept = np.flatnonzero(self.used > 1)
        kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[:MOST_UNITS // 2]])
        names, text = list(self.at), self.text
        links, times, sizes, used, wrong = self.links, self.times, self.sizes, self.used, self.wrong
        self.clear()
        names = [names[i] for i in kept.tolist()]
        self.at = {u: i for i, u in enumerate(names)}
        self.chars = sum(map(len, names))
        if self.chars > MOST_CHARS // 2:
            return self.clear()
        self.text = [text[i] for i in kept.tolist()]
        self.wrong = wrong.intersection(self.at)
        self.links.extend(*links.take(kept))
        self.times.extend(*times.take(kept))
        self.sizes, self.used = sizes[kept], used[kept] // 2

    def learn(self, units: set[str]) -> None:
        fresh = units.difference(self.at)
        open_ended = [u for u in fresh if u[-1].isspace()]  # what follows could join their last token
        closed = list(fresh.difference(open_ended))
        for some in range(0, len(closed), 20_000):
            self._learn(closed[some:some + 20_000])
        self._learn(open_ended)

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        t = self.pair
        first = len(self.at)
        self.at.update(zip(fresh, range(first, first + len(fresh))))
        self.chars += sum(map(len, fresh))
        right = [True] * len(fresh)
        found = t.together(fresh) if t.cuts and not any(u[-1].isspace() for u in fresh) else None
        if found is None:  # one by one, leaving out those whose bytes come back changed
            a, b = t.each(fresh)
            right = [t.joined(t.bytes_a, np.array(x)) == u.encode() == t.joined(t.bytes_b, np.array(y))
                     for u, x, y in zip(fresh, a, b)]
            found = [np.fromiter(chain.from_iterable(x for x, r in zip(ids, right) if r), np.int64) for ids in (a, b)]
        flat_a, flat_b = found
        sizes = np.array([len(u.encode()) if r else 0 for u, r in zip(fresh, right)], np.int64)
        # units stand one after the other, so places in bytes tell units apart
        end_a, end_b = np.cumsum(t.size_a[flat_a]), np.cumsum(t.size_b[flat_b])
        _, cut_a, cut_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        start_a, start_b = cut_a + 1 - n_a, cut_b + 1 - n_b
        unit = np.searchsorted(np.cumsum(sizes), end_a[cut_a])  # of each group
        groups = np.bincount(unit, minlength=len(fresh))
        wide = n_a * n_b > WIDE
        n_links = np.where(wide, 0, n_a * n_b)
        of = np.repeat(np.arange(len(n_a)), n_links)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_links) - n_links, n_links)
        link = flat_a[start_a[of] + nth // n_b[of]] << 32 | flat_b[start_b[of] + nth % n_b[of]]
        link_unit, times = unit[of], np.ones(len(of), np.int64)
        for g in np.flatnonzero(wide).tolist():
            x, many_x = np.unique(flat_a[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
            y, many_y = np.unique(flat_b[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
            link = np.append(link, (x[:, None] << 32 | y).ravel())
            times = np.append(times, (many_x[:, None] * many_y).ravel())
            link_unit = np.append(link_unit, np.full(len(x) * len(y), unit[g]))
        # equal pairs of a unit together
        order = np.lexsort((link, link_unit))
        link, link_unit, times = link[order], link_unit[order], times[order]
        new = np.append(True, (link[1:] != link[:-1]) | (link_unit[1:] != link_unit[:-1]))[:len(link)]
        at = np.flatnonzero(new)
        times = np.add.reduceat(times, at) if len(at) else times
        link, link_unit = link[at], link_unit[at]
        per_unit = np.bincount(link_unit, minlength=len(fresh))
        self.links.extend(link, per_unit)
        self.times.extend(times, per_unit)
        self.sizes = np.concatenate([self.sizes, np.stack([
            np.bincount(unit, n_a, len(fresh)), np.bincount(unit, n_b, len(fresh)), groups,
            np.bincount(unit, n_a * n_b, len(fresh))], 1).astype(np.int64)])
        names_a, names_b = [t.names[i] for i in flat_a.tolist()], [t.names[i] for i in flat_b.tolist()]
        shown = [names_a[i] + b"|" + names_b[j] if m == n == 1 else
                 b",".join(names_a[i:i + m]) + b"|" + b",".join(names_b[j:j + n]) for i, m, j, n in zip(
                     start_a.tolist(), n_a.tolist(), start_b.tolist(), n_b.tolist())]
        ends = np.cumsum(groups).tolist()
        self.text += [b";".join(shown[x:y]) for x, y in zip([0] + ends, ends)]
        self.wrong.update(u for u, r in zip(fresh, right) if not r)

    def full(self) -> bool:
        return len(self.at) > MOST_UNITS or self.chars > MOST_CHARS

    def sequences(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The units of each text, none if it has no tokens; what is new is learned for all texts together."""
        if self.full():
            self.forget()
        cut = [(CUT.split(" " + t) if self.pair.cuts else [" " + t]) if t else [] for t in texts]
        self.learn(set().union(*cut))
        every = np.array([self.at[u] for names in cut for u in names], np.int64)
        self.used = np.append(self.used, np.zeros(len(self.at) - len(self.used), np.int64))
        self.used += np.bincount(every, minlength=len(self.used))
        ends = np.cumsum([len(names) for names in cut])
        for text, names, end in zip(texts, cut, ends.tolist()):
            rows = every[end - len(names):end]
            if self.wrong and not self.wrong.isdisjoint(names):
                self.learn({" " + text})
                rows = np.array([self.at[" " + text]] if " " + text not in self.wrong else [], np.int64)
            yield rows


@lru_cache(maxsize=1)
def units_of(path_a: str, path_b: str) -> Units:
    return Units(tokenizers(path_a, path_b))


def packed(values: np.ndarray) -> bytes:
    """Bytes of equal rank together, which shuffles and files compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def shaped(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
    """The rows with all columns, null where the kind has none."""
    types = {c.split()[0]: {"long": "Int64", "int": "Int32"}.get(c.split()[1], object) for c in ROWS.split(", ")}
    return rows.assign(kind=kind).reindex(columns=list(types)).astype(types)


def slices(texts: pd.Series) -> Iterator[slice]:
    """Stretches of texts of about ``SLICE_CHARS`` characters."""
    first, chars = 0, 0
    for i, text in enumerate(texts, 1):
        chars += len(text)
        if chars >= SLICE_CHARS or i == len(texts):
            yield slice(first, i)
            first, chars = i, 0


def blocks_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of three kinds: blocks of documents, their irregular pairs, and counts of identity pairs per task."""
    def block(number: int, ids: list, seqs: list[np.ndarray], units: Units, same: np.ndarray) -> Iterator[pd.DataFrame]:
        length = np.array([len(s) for s in seqs], np.int64)
        used, seq = np.unique(np.concatenate([*seqs, np.zeros(0, np.int64)]), return_inverse=True)
        doc = np.repeat(np.arange(len(seqs)), length)
        link, n = units.links.take(used)
        times, _ = units.times.take(used)
        pairs, pair = np.unique(link, return_inverse=True)
        # each pair once per document: distinct (document, unit), then distinct (document, pair)
        each = np.unique(doc * max(len(used), 1) + seq)
        of, unit = each // max(len(used), 1), each % max(len(used), 1)
        at = np.cumsum(n) - n
        held = np.unique(np.repeat(of, n[unit]) * max(len(pairs), 1) + pair[spans(at[unit], n[unit])])
        docs_with = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
        del held, each, of, unit, link, doc
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        regular = units.pair.same[a] == b
        np.add.at(same, a[regular], docs_with[regular])
        sums = [np.append(0, np.cumsum(x[seq])) for x in units.sizes[used].T]
        ends = np.cumsum(length)
        n_a, n_b, n_groups, n_links = (packed(s[ends] - s[ends - length]) for s in sums)
        text = [units.text[u] for u in used.tolist()]
        places = seq.tolist()
        digests = b"".join([hashlib.sha256(b";".join([text[u] for u in places[e - k:e]])).digest() if k else bytes(32)
                            for e, k in zip(ends.tolist(), length.tolist())])
        yield shaped(pd.DataFrame({
            "block": [number], "ids": ["\n".join(ids).encode()], "n_a": [n_a], "n_b": [n_b], "n_groups": [n_groups],
            "n_links": [n_links], "digest": [digests], "length": [packed(length)],
            "seq": [packed(seq.astype(np.uint32))], "links": [packed(n)], "pair": [packed(pair.astype(np.uint32))],
            "times": [packed(times)], "pair_a": [packed(a.astype(np.uint32))]}), BLOCK)
        place = np.flatnonzero(~regular)
        for some in range(0, len(place), 200_000):
            part = place[some:some + 200_000]
            yield shaped(pd.DataFrame({"block": number, "place": part, "a": a[part], "b": b[part],
                                       "n": docs_with[part]}), PAIR)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = units_of(path_a, path_b)
        same = np.zeros(len(units.pair.same), np.int64)
        number, ids, seqs, n = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for some in slices(batch["text"]):
                if ids and units.full():  # some are forgotten next, the others get new numbers
                    yield from block(number, ids, seqs, units, same)
                    number, ids, seqs, n = number + 1, [], [], 0
                found = units.sequences(batch["text"].iloc[some].tolist())
                for doc_id, seq in zip(batch["doc_id"].iloc[some], found):
                    seqs.append(seq)
                    ids.append("" if doc_id is None else doc_id)
                    n += len(seq)
                    if n >= BLOCK_UNITS:
                        yield from block(number, ids, seqs, units, same)
                        number, ids, seqs, n = number + 1, [], [], 0
        if ids:
            yield from block(number, ids, seqs, units, same)
        seen = np.flatnonzero(same)
        yield shaped(pd.DataFrame({"a": seen, "n": same[seen]}), SAME)

    return materialize(docs.mapInPandas(cut, ROWS), "alignment")


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: numbers of tokens, groups and links, what its links count, and a digest of its groups."""
    spark = docs.sparkSession
    plain = picked(docs, doc_id=id_column, text=text_column)
    rows = blocks_of(plain.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"),
                                  F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), path_a, path_b)
    blocks = rows.filter(F.col("kind") == BLOCK)
    pairs = rows.filter(F.col("kind") == PAIR).select("block", "place", "a", "b", "n")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # both vectors have one number for each id of A
    regular = rows.filter(F.col("kind") == SAME).groupBy("a").agg(F.sum("n").alias("count"))
    highest = counts.select("a", "count").unionByName(regular).groupBy("a").agg(F.max("count").alias("count"))
    size = len(tokenizers(path_a, path_b).same)

    def vector(of_a: DataFrame) -> np.ndarray:
        found = of_a.toPandas()
        out = np.zeros(size, np.int64)
        out[found["a"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
        return out

    same = spark.sparkContext.broadcast(vector(regular))
    best = spark.sparkContext.broadcast(vector(highest))
    back = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), F.col("place").alias("at"), "count")

    def add_up(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        a = unpacked(row["pair_a"], np.uint32)
        count = same.value[a]
        count[found["at"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
        pair, times = unpacked(row["pair"], np.uint32), unpacked(row["times"], np.int64)
        ends = np.cumsum(unpacked(row["links"], np.int64))
        starts = np.append(0, ends[:-1])[:len(ends)]
        seq, length = unpacked(row["seq"], np.uint32), unpacked(row["length"], np.int64)
        last = np.cumsum(length)

        def summed(value: np.ndarray) -> np.ndarray:
            links = np.append(0, np.cumsum(times * value[pair]))
            units = np.append(0, np.cumsum((links[ends] - links[starts])[seq]))
            return units[last] - units[last - length]

        digest = row["digest"]
        return pd.DataFrame({
            "doc_id": pd.array([int(i) if i else None for i in row["ids"].decode().split("\n")], "Int64"),
            **{c: unpacked(row[c], np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "n_best": summed((count == best.value[a]).astype(np.int64)), "count_sum": summed(count),
            "groups_sha256": [digest[32 * i:32 * i + 32].hex() if k else "" for i, k in enumerate(length.tolist())]})

    return blocks.groupBy("block").cogroup(back.groupBy("of_block")).applyInPandas(add_up, RESULT)


def groups(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """The alignment itself, one row per row of ``docs``: doc_id and groups ``a1,a2|b1;a3|b2,b3``."""
    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        units = units_of(path_a, path_b)
        return pd.Series([b";".join([units.text[u] for u in seq.tolist()]).decode() for some in slices(texts)
                          for seq in units.sequences(texts.iloc[some].tolist())], dtype=object)

    plain = picked(docs, doc_id=id_column, text=text_column)
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"),
                        shown(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("groups"))
