"""Near copies of the pipeline against exact shingle similarity, large groups, and the defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import near_copies
from matchloom.session import materialize


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(draw, words, edits):
    out = list(words)
    for i in draw.sample(range(len(out)), edits):
        out[i] = f"new{draw.randrange(10 ** 9)}"
    return out


def test_groups_follow_exact_similarity(spark):
    draw = random.Random(5)
    texts = []
    for n in range(60):
        base = [f"w{int(draw.paretovariate(0.6)) % 5000}" for _ in range(draw.choice([60, 150, 400, 1500]))]
        texts.append(base)
        for share in (0.004, 0.01, 0.03, 0.08):
            texts.append(edited(draw, base, max(1, int(share * len(base)))))
        texts.append(base[:len(base) // 2] + [f"other{draw.randrange(10 ** 9)}" for _ in range(len(base) // 2)])
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.dedup(docs).collect()}
    of = [(i, [similarity(sets[i], sets[j]) for j in range(i - i % 6, i - i % 6 + 6) if j != i]) for i in range(len(texts))]
    assert all(i in kept for i, s in of if max(s) < 0.74)  # nothing near: stays
    assert all(i in kept for i in range(0, len(texts), 6))  # the smallest id of its group
    near = [i for i in range(len(texts)) if any(similarity(sets[i], sets[j]) >= 0.84 for j in range(i - i % 6, i))]
    assert len(near) > 60
    assert sum(i not in kept for i in near) >= 0.98 * len(near)


def test_no_pair_of_other_texts_is_linked(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.8)) % 300}" for _ in range(draw.randrange(1, 80)))) for i in range(1500)]
    seen = near_copies.described(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = materialize(seen.groupBy("words").agg(
        F.min("doc_id").alias("i"), F.first("anchors").alias("anchors"), F.first("bits").alias("bits")), "texts")
    at = {bytes(r.words): r.i for r in texts.collect()}
    for a, b in near_copies.links(texts.drop("i")).collect():
        assert similarity(shingles(rows[at[bytes(a)]][1]), shingles(rows[at[bytes(b)]][1])) >= 0.6


def test_every_pair_at_the_threshold_is_linked(spark):
    draw = random.Random(11)
    texts = []
    for n in range(150):  # five edits of 5-word shingles each, placed apart, at a similarity just above 0.8
        size = draw.choice([225, 235, 250])
        base = [f"w{draw.randrange(10 ** 9)}" for _ in range(size)]
        texts.append(base)
        other = list(base)
        for i in range(5):
            other[10 + 20 * i] = f"new{draw.randrange(10 ** 9)}"
        texts.append(other)
    texts = [" ".join(t) for t in texts]
    of = [similarity(shingles(texts[i]), shingles(texts[i + 1])) for i in range(0, len(texts), 2)]
    assert all(0.79 < s < 0.83 for s in of) and 20 < sum(s >= 0.8 for s in of)
    kept = {r.doc_id for r in near_copies.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not [i for i, s in enumerate(of) if s >= 0.8 and 2 * i + 1 in kept]


def test_prefixes_of_similar_sets_share_a_shingle():
    draw = np.random.default_rng(3)
    for n in range(1, 200):
        same = draw.choice(10 ** 6, n, replace=False)
        more = 10 ** 6 + np.arange(n // 4)  # n of n + n // 4 shared: 0.8 or a little more
        common = np.sort(draw.choice(same, n // 2, replace=False))
        times = draw.integers(3, 9, len(common))
        for cut in (0, len(more) // 2, len(more)):
            a, b = (np.sort(np.append(same, x)) for x in (more[:cut], more[cut:]))
            assert set(near_copies.prefix(a, common, times)) & set(near_copies.prefix(b, common, times))


def test_odd_sketches_differ_at_no_more_places_than_sets():
    draw = np.random.default_rng(5)
    for n in (1, 3, 40, 700, 6000):
        for more in (0, 1, n // 4, n):
            keys = draw.integers(-2 ** 63, 2 ** 63, n + more, dtype=np.int64)
            a, b = keys[:n], keys[more:]
            differ = len(set(a.tolist()) ^ set(b.tolist()))
            places = int(np.bitwise_count((near_copies.odd_places(a) ^ near_copies.odd_places(b)).view(np.uint64)).sum())
            assert places <= differ and (places - differ) % 2 == 0


def test_sets_are_made_only_of_texts_that_may_be_near_copies(spark, monkeypatch):
    draw = random.Random(13)
    rows = [(i, " ".join([f"p{i // 2}-{n}" for n in range(300)] + [f"u{draw.randrange(10 ** 9)}" for _ in range(300)]))
            for i in range(12)]  # two texts have half of their words in common
    made, write = {}, near_copies.materialize

    def kept(df, label, *more):
        made[label] = write(df, label, *more)
        return made[label]

    monkeypatch.setattr(near_copies, "materialize", kept)
    assert near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 12
    assert made["placed"].count() and made["asked"].count() == 0 and made["sets"].count() == 0


def test_large_group_and_shared_passage(spark):
    draw = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    group = [" ".join(edited(draw, base, 2)) for _ in range(800)]
    passage = " ".join(f"p{i}" for i in range(60))
    clean = [" ".join(f"u{draw.randrange(10 ** 9)}" for _ in range(60)) + " " + passage for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(group + clean)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.dedup(docs).collect()} == {0, *range(800, 1000)}


def test_anchors_cover_their_parts():
    bits = np.random.default_rng(1).integers(0, 2, (50, near_copies.BITS)).astype(np.uint8)
    own = near_copies.anchors(bits)
    parts = bits.reshape(50, near_copies.PARTS, -1)
    for flip in range(31):  # one of the 32 words within one bit of a part is its anchor: changing that bit keeps it
        changed = parts.copy()
        changed[:, 0, flip] ^= 1
        same = near_copies.anchors(changed.reshape(50, -1)) == own
        assert same[:, 1:].all()
    few = bits.copy()
    for row in range(50):  # 63 changed bits leave a part without a change
        few[row, np.random.default_rng(row).choice(near_copies.BITS, 63, replace=False)] ^= 1
    assert (near_copies.anchors(few) == own).any(axis=1).all()


def test_defined_cases(spark):
    rows = [(5, "one two three", 0, "x", "en"), (3, "One  two three", 1, "x", "de"), (None, "one two three", 2, None, None),
            (8, None, 3, "x", "en"), (7, " \t", 4, "x", "en"), (9, "alone", 5, "x", "en"), (9, "alone", 6, "x", "fr"),
            (None, "nobody knows this idiot", 7, "x", "en"), (1, "word " * 30_000, 8, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int, Text string, lang string")
    kept = near_copies.dedup(docs)
    assert kept.columns == docs.columns
    got = [(r[0], r[1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, "One  two three"), (7, " \t"), (9, "alone"), (None, "nobody knows this idiot"),
                                           (1, "word " * 30_000)], key=str)
    none = near_copies.dedup(docs.limit(0))
    assert none.columns == docs.columns and none.count() == 0
