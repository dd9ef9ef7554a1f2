"""Token counts with a linear longest-match automaton (operator 4).

A word with its word mark in front is cut greedily into the longest pieces of a vocabulary. The
vocabulary is a trie; a node's failure link leads to the node that stands for what is left after
the longest pieces at its front are popped, and the number of pieces popped on the way is
precomputed. Reading a word takes one step per character and adds popped counts, so its
number of pieces is known without cutting a single one. A character no piece starts with counts as
``unknown_cost`` of it, by default the number of its UTF-8 bytes, which is what byte
fallback makes of it.

The vocabulary comes from a file whose path is a parameter; nothing is trained. The automaton has
as many nodes as the vocabulary has prefixes and is built once per Python worker. Documents are one
row each in a projection without a shuffle; within a batch each distinct word is read once.

Defined cases: null and empty texts have no words and no tokens; very long words are read in
linear time; repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import text_of

MARK = "▁"


def byte_cost(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


class LongestMatch:
    """Trie of pieces with failure links and counts of popped pieces.

    Characters that occur in pieces without being one are added as pieces that cost what an unknown
    character costs, so every node's string can be popped: ``fail[v]`` is the node after that,
    ``tokens[v]`` and ``missed[v]`` what it adds to the tokens and to the unknown characters.
    """

    def __init__(self, pieces: list[str], unknown_cost: Callable[[str], int] = byte_cost):
        self.unknown_cost = unknown_cost
        worth = dict.fromkeys((p for p in pieces if p), (1, 0))
        for char in sorted({c for p in worth for c in p} - set(worth)):
            worth[char] = (unknown_cost(char), 1)
        self.next: list[dict[str, int]] = [{}]
        final: dict[int, tuple[int, int]] = {}
        for piece, value in worth.items():
            v = 0
            for char in piece:
                if char not in self.next[v]:
                    self.next[v][char] = len(self.next)
                    self.next.append({})
                v = self.next[v][char]
            final[v] = value
        n = len(self.next)
        self.fail, self.tokens, self.missed = [0] * n, [0] * n, [0] * n
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for char, u in self.next[v].items():
                queue.append(u)
                if u in final:
                    self.tokens[u], self.missed[u] = final[u]
                    continue
                # pop from the parent's string until what is left can be followed by char
                z, t, m = self.fail[v], self.tokens[v], self.missed[v]
                while char not in self.next[z]:
                    t, m, z = t + self.tokens[z], m + self.missed[z], self.fail[z]
                self.fail[u], self.tokens[u], self.missed[u] = self.next[z][char], t, m

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, characters that no piece covers)."""
        v = tokens = missed = 0
        follow, fail, popped, lost = self.next, self.fail, self.tokens, self.missed
        for char in text:
            while (u := follow[v].get(char)) is None and v:
                tokens += popped[v]
                missed += lost[v]
                v = fail[v]
            if u is None:
                tokens += self.unknown_cost(char)
                missed += 1
            else:
                v = u
        while v:
            tokens += popped[v]
            missed += lost[v]
            v = fail[v]
        return tokens, missed


def piece_vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece model file; control and byte pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(piece_vocabulary(path))


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown (characters outside all pieces)."""
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(path)
        for texts in batches:
            known: dict[bytes, int] = {}
            rows = [[known.setdefault(w, len(known)) for w in t.encode().split()] for t in texts]
            costs = np.array([machine.count(MARK + w.decode()) for w in known] or [(0, 0)], np.int64)
            sums = [costs[r].sum(axis=0) if r else (0, 0) for r in rows]
            yield pd.DataFrame({"n_words": [len(r) for r in rows],
                                "n_tokens": [int(s[0]) for s in sums],
                                "n_unknown": [int(s[1]) for s in sums]}, dtype="int64")

    counted = F.pandas_udf(count, "n_words long, n_tokens long, n_unknown long")
    return docs.select(docs[id_column].cast("long").alias("doc_id"),
                       counted(text_of(docs, text_column)).alias("_c")).select("doc_id", "_c.*")
