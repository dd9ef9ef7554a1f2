"""Periodic runs against a brute-force search, in whole documents and in tiles dealt to other tasks."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import periodic_runs as pr
from matchloom.llm import queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def ordered(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def noise(r, n, kinds):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def texts():
    r = random.Random(11)
    out = [None, "", " \t\n", "a", " ".join(["a"] * 11), " ".join(["a"] * 12), " ".join(["a", "b"] * 6)]
    for n in (30, 200, 700, 1500):
        for kinds in (2, 3, 40):
            out.append(" ".join(noise(r, n, kinds)))
    for p in (1, 5, 63, 64, 65, 100, 127, 128, 300, 511):
        root = noise(r, p, 50)
        out.append("\t".join(noise(r, r.randrange(40), 50) + (root * 7)[:2 * p + r.randrange(p * 3 + 12)] + noise(r, 30, 50)))
    out.append(" ".join(["a"] * 3000))
    out.append(" ".join((["x"] * 70 + ["y"]) * 30))
    inner = noise(r, 80, 50) * 3 + noise(r, 20, 50)
    out.append(" ".join(inner * 3 + noise(r, 10, 5)))
    return out


@pytest.mark.parametrize("long_words", [pr.LONG_WORDS, 128])
def test_runs_equal_brute_force(spark, long_words):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT_ string").withColumnRenamed("TEXT_", "Text")
    got = pr.find_runs(docs, long_words=long_words).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").split()
        runs = ordered(brute_runs(words))
        want.append((doc_id, len(words), runs, brute_collapse(words, runs) if runs else None,
                     hashlib.sha256(" ".join(words).encode()).hexdigest()))
    key = repr
    assert sorted([(g.doc_id, g.n_words, [(r.start, r.length, r.period) for r in g.runs], g.collapsed, g.words_sha256)
                   for g in got], key=key) == sorted(want, key=key)


def test_tile_sizes_do_not_change_fragments():
    r = random.Random(3)
    words = [r.randrange(4) for _ in range(500)] + [r.randrange(4) for _ in range(90)] * 9
    z = pr.z_values(words, len(words))
    for i in range(1, len(words)):
        k = 0
        while i + k < len(words) and words[k] == words[i + k]:
            k += 1
        assert z[i] == k
    assert pr.shorter_periods(360) == [180, 120, 72] and pr.shorter_periods(97) == [1] and pr.shorter_periods(1) == []
    p, s, e = pr.low_fragments(np.array([1, 2] * 10, np.int32))
    assert (2, 0, 20) in zip(p.tolist(), s.tolist(), e.tolist())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pr.find_runs(docs).collect() == []
    assert pr.with_planted_periods(docs).collect() == []


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 3000:
            continue  # the search here takes the square of the words
        runs = ordered(brute_runs(words))
        row = got[d.doc_id]
        assert row.n_runs == len(runs) and row.n_words == n
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest()
    assert planted
