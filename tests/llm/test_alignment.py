"""Alignment of tokens against whole-text tokenization and a plain count of linked pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from matchloom.llm import alignment as al
from matchloom.llm import queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(t, text):
    """Groups (list of A ids, list of B ids) of the whole text, none if bytes come back changed."""
    if not text:
        return []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    data = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != data or b"".join(t.bytes_b[i] for i in b) != data:
        return []
    out, x, y, i, j = [], [], [], 0, 0
    at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            x.append(a[i])
            at_a += len(t.bytes_a[a[i]])
            i += 1
        else:
            y.append(b[j])
            at_b += len(t.bytes_b[b[j]])
            j += 1
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def brute(rows):
    t = al.tokenizers(A, B)
    docs = [(i, plain_groups(t, text)) for i, text in rows]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for _, g in docs]
    count = Counter(pair for held in links for pair in held)
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    return [(i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(held.values()),
             sum(n for pair, n in held.items() if count[pair] == best[pair[0]]),
             sum(n * count[pair] for pair, n in held.items()),
             hashlib.sha256(shown(g).encode()).hexdigest() if g else "") for (i, g), held in zip(docs, links)]


def odd_texts():
    r = random.Random(12)
    letters = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "\r\n", " ", "  ", "  ", "\x1c ",
               " ", "'s", "'ll ", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "é", "é", " ́", "ﬁ", "日本", "🙂",
               "​", "\x00", "\x01", "12", "3.14", "...", "!!", "Ａ", "ß", "=", "----", "\u0085", "﻿", "　"]
    out = ["", " ", "  ", "\n", "a", " a", "a ", "a  ", "▁", "a▁b c", "x" * 3000, "= " * 500, "word\n\n  word", "a" * 9 + " "]
    out += ["".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 150) for _ in range(60)]
    return out


def test_units_give_the_tokens_of_whole_texts():
    t = al.tokenizers(A, B)
    units = al.Units(t)
    assert t.cuts
    docs = odd_texts()
    for text, seq in zip(docs, units.sequences(docs)):
        got = b";".join(units.text[u] for u in seq).decode()
        assert got == shown(plain_groups(t, text)), repr(text)


def test_units_give_the_tokens_of_documents(spark):
    t = al.tokenizers(A, B)
    units = al.Units(t)
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text, seq in zip(docs, units.sequences(docs)):
        assert b";".join(units.text[u] for u in seq).decode() == shown(plain_groups(t, text))


def test_identity_map():
    t = al.tokenizers(A, B)
    assert len(t.same) == t.a.get_vocab_size()
    pairs = [(i, j) for i, j in enumerate(t.same.tolist()) if j >= 0]
    assert len(pairs) > 10_000 and all(t.bytes_a[i] == t.bytes_b[j] for i, j in pairs)
    known = set(t.bytes_b[3:])
    assert all(t.bytes_a[i] not in known for i, j in enumerate(t.same.tolist()) if j < 0)


def test_wide_groups_have_the_same_links(monkeypatch):
    t, found = al.tokenizers(A, B), []
    for wide in (al.WIDE, 0):
        monkeypatch.setattr(al, "WIDE", wide)
        units = al.Units(t)
        list(units.sequences(odd_texts()))
        names = [name for name, _ in sorted(units.at.items(), key=lambda x: x[1])]
        found.append({n: sorted(zip(*(x.take(np.array([i]))[0].tolist() for x in (units.links, units.times))))
                      for i, n in enumerate(names)})
    assert found[0] == found[1]


@pytest.mark.parametrize("units", [al.BLOCK_UNITS, 50])
def test_counts_equal_brute_force(spark, monkeypatch, units):
    monkeypatch.setattr(al, "BLOCK_UNITS", units)
    rows = [(i if i % 7 else None, text) for i, text in enumerate(odd_texts()[:200])] + [(3, None), (3, None)]
    rows += rows[20:40]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Text_ string").withColumnRenamed(
        "Text_", "TEXT").repartition(3)
    al.units_of.cache_clear()
    got = sorted(map(tuple, al.align(docs, A, B).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert al.align(docs, A, B).collect() == [] and al.groups(docs, A, B).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(d.doc_id, d.text) for d in docs])
    got = [tuple(r) for r in queries.QUERIES["op12_alignment"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    shown_groups = {r.doc_id: r.groups for r in al.groups(spark.read.parquet(f"{SF}/documents.parquet"), A, B).collect()}
    assert {i: hashlib.sha256(g.encode()).hexdigest() if g else "" for i, g in shown_groups.items()} == {
        w[0]: w[-1] for w in want}
