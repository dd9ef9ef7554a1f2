"""Packing documents into training sequences, first-fit decreasing in random groups (operator 10).

Documents are dealt to groups of about ``GROUP_BYTES`` of text by a hash of the row and its number, which spreads rows
that are equal too. A group's documents are
tokenized and cut into pieces of at most the sequence length; pieces go, longest first, to the
first sequence with room. A tournament tree over the sequences holds the largest free room of every
subtree, so finding that sequence takes a walk from the root. What first-fit leaves free in a group
is then filled from its emptiest sequences, cutting their pieces where needed, so a group ends with
at most one unfilled sequence.

The text is shuffled once, each group is one bounded task input, and no token leaves its
group. Distinct words are tokenized once per worker: the tokenizer treats words between ASCII white
space on their own. Defined cases: null and empty texts are one token, the document end; texts of
any length are cut; repeated rows are packed each; a null doc_id is packed like any other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import row_keys, text_of

LENGTH = 4096
END = 2
GROUP_BYTES = 16 << 20
SEED = 10
STRETCH = 4 << 20
MOST_WORDS = 1_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


class Ragged:
    """Growing rows of numbers of unequal length in two flat arrays."""

    def __init__(self, kind):
        self.flat, self.starts, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def join(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of the given rows, one after the other."""
        sizes = self.sizes[rows]
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())]


class WordIds:
    """Token ids of words between ASCII white space, remembered up to ``MOST_WORDS`` words.

    A word is a list of parts, cut as the tokenizer's own pattern cuts them; parts are tokenized once and
    many in one call, told apart by the token that ends each. Words with characters
    beyond U+017F, or that might hold a special token, are one part and tokenized each on its own.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-įĲ-ſ]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}  # word -> row of words
        self.part_at: dict[str, int] = {}  # part, or a blank and a word that is its own part -> row of parts
        self.words, self.parts = Ragged(np.int64), Ragged(np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.array([i for ids in coded for i in ids], np.uint32),
                np.array([len(ids) for ids in coded], np.int64))

    def _encode_letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of a-z alone, which normalising and byte mapping leave as they are."""
        coded = [[token.id for token in self.model.tokenize(text)] for text in texts]
        return (np.array([i for ids in coded for i in ids], np.uint32),
                np.array([len(ids) for ids in coded], np.int64))

    def _encode_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = self._encode([" ".join(texts)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(texts):
            return self._encode(texts)
        return ids, np.diff(ends, prepend=0)

    def learn(self, words: set[bytes]) -> None:
        if len(self.at) + len(words) > MOST_WORDS:
            self.clear()
        rows, sizes, letters, plain, odd = [], [], [], [], []
        for word in words.difference(self.at):
            self.at[word] = len(self.at)
            text = word.decode()
            if b"<|" not in word and (word.isascii() or self.plain.fullmatch(text)):
                text, new = text.lower(), plain
                if text.isalpha():
                    parts = [text]
                elif text[:-1].isalpha() and not text[-1].isalnum() and text[-1] < "\x80":
                    parts = [text[:-1], text[-1]]
                else:
                    parts = self.cut.findall(text)
            else:
                parts, new = [" " + text], odd
            for part in parts:
                row = self.part_at.get(part)
                if row is None:
                    kind = letters if new is plain and part.isascii() and part.isalpha() else new
                    row = self.part_at[part] = -(len(kind) * 3 + (0 if kind is letters else 1 if kind is plain else 2)) - 1
                    kind.append(part)
                rows.append(row)
            sizes.append(len(parts))
        # new parts were numbered below zero, by kind and place; now each kind's first row is known
        first = len(self.parts) + np.cumsum([0, len(letters), len(plain)])
        rows = np.array(rows, np.int64)
        place, kind = np.divmod(-rows - 1, 3)
        rows = np.where(rows < 0, first[kind] + place, rows)
        for some, start in zip((letters, plain, odd), first.tolist()):
            self.part_at.update(zip(some, range(start, start + len(some))))
        coded = [encode([p.strip(" ") for p in some[at:at + 1000]])
                 for some, encode in ((letters, self._encode_letters), (plain, self._encode_parts), (odd, self._encode))
                 for at in range(0, len(some), 1000)]
        if coded:
            self.parts.extend(np.concatenate([c[0] for c in coded]), np.concatenate([c[1] for c in coded]))
        self.words.extend(rows, np.array(sizes, np.int64))

    def document(self, words: list[bytes]) -> np.ndarray:
        """Ids of a document with its end; the words must have been learned."""
        row = self.at
        at = np.array([row[w] for w in words], np.int64)
        return np.append(self.parts.join(self.words.join(at)), np.uint32(END))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space; the tokenizer ignores case but in special tokens."""
    data = text.encode()
    return (data if b"<|" in data else data.lower()).split()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


class Bins:
    """Open sequences under a tournament tree of free room; the leftmost that fits is found first."""

    def __init__(self, capacity: int, room: int):
        self.room = room
        self.width = 1
        while self.width < max(1, capacity):
            self.width *= 2
        self.tree = [room] * (2 * self.width)

    def place(self, size: int) -> int:
        node = 1
        while node < self.width:
            node = 2 * node if self.tree[2 * node] >= size else 2 * node + 1
        where = node - self.width
        self.tree[node] -= size
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])
        return where


def pack_lengths(lengths: list[int], room: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents with these numbers of tokens."""
    pieces = [(min(room, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, room)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins = Bins(len(pieces), room)
    held: list[list[tuple[int, int, int]]] = []
    for size, d, at in pieces:
        where = bins.place(size)
        if where == len(held):
            held.append([])
        held[where].append((d, at, size))
    # fill what is free from the emptiest sequences, cutting their pieces
    free = [room - sum(p[2] for p in h) for h in held]
    order = sorted(range(len(held)), key=lambda b: (free[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        target, giver = order[low], order[high]
        if not free[target]:
            low += 1
            continue
        if not held[giver]:
            high -= 1
            continue
        d, at, size = held[giver].pop()
        moved = min(size, free[target])
        held[target].append((d, at, moved))
        free[target] -= moved
        if moved < size:
            held[giver].append((d, at + moved, size - moved))
        free[giver] += moved
    return [(d, at, size, b) for b, h in enumerate([h for h in held if h]) for d, at, size in h]


def stretches(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``STRETCH`` characters: words take several times the room of their text."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack_group(docs: pd.DataFrame, path: str) -> pd.DataFrame:
    """Pieces of one group's documents (columns doc_id, text, group), in a fixed order."""
    coder = word_ids(path)
    docs = docs.sort_values(["_rid", "_rhash"], kind="stable")
    coded = []
    for stretch in stretches(docs["text"]):
        split = [words_of(t) for t in stretch]
        coder.learn(set().union(*split))
        coded += [coder.document(s) for s in split]
    pieces = pack_lengths([len(c) for c in coded])
    ids, group = docs["doc_id"].tolist(), int(docs["_group"].iloc[0])
    rows, at, last = [], 0, -1
    for d, start, size, b in pieces:
        at = 0 if b != last else at
        last = b
        crc = zlib.crc32(coded[d][start:start + size].astype("<u4").tobytes())
        rows.append((ids[d], start, size, crc, len(coded[d]), (group << 32) | b, at))
        at += size
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
         group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    text = text_of(docs, text_column)
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"),
                        *row_keys(docs, id_column, text_column)).withColumn(
        "_group", F.pmod(F.xxhash64(F.lit(SEED), "_rid", "_rhash", F.monotonically_increasing_id()), F.lit(groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return pack_group(group, path)

    return dealt.groupBy("_group").applyInPandas(packed, SCHEMA)
