"""Each training-data operator against a brute-force version, on edge cases and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.base import duck
from matchloom.llm import (exact_dedup, langid, licenses, mixing, neighbours, packing, queries, simhash,
                           suffix_tree, token_counts, toxicity)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, digest int, _c0 int"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))
ROWS = [
    (1, "The MIT License and\nthe Apache License, Version 2.0", "en", "b"), (2, None, None, None), (3, "", "en", "a"),
    (4, "  \t\n", "en", "a"), (5, "one two", "en", "b"), (6, "one  two", "en", "b"), (7, "One two", "de", "c"),
    (None, "nobody knows this idiot", "en", "a"), (None, None, "fr", "c"), (9, LONG, "en", "big"),
    (10, LONG + " end", "en", "big"), (11, "ñandú <|endoftext|> 日本語 it's x ½", "es", "é"),
    (11, "ñandú <|endoftext|> 日本語 it's x ½", "es", "é"), (12, "GENERAL\tPUBLIC license!", None, "a"),
    (13, "12 345 !!", "en", "a"), (-5, "one two", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 0, "x", 1, 2) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def test_exact_dedup(spark, docs):
    index = exact_dedup.new_index(spark)
    got = exact_dedup.decide(docs, index).collect()
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest()].append((i, t or ""))
    assert len(got) == len(ROWS)
    for r in got:
        rows = groups[bytes(r["digest"])]
        first = min(rows, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (first[0], len(rows))
    assert sum(r["kept"] for r in got) == len(groups)
    again = exact_dedup.decide(docs.limit(6), index).collect()  # a later batch: all indexed before
    assert not any(r["kept"] for r in again)
    kept = exact_dedup.dedup(docs, exact_dedup.new_index(spark))
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_sql(spark):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(map(tuple, queries.op1_exact_dedup(spark, SF).select(*cols).collect()))
    want = duck(SF).execute(f"select {', '.join(cols)} from ({queries.ORACLE['op1_exact_dedup']})").fetchall()
    assert got == sorted(want)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("which", ["docs", "table"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    sizes = Counter()
    for r in df.select("source", "text").collect():
        sizes[r["source"]] += len(words(r["text"]))
    target, taken = brute_targets(sizes), Counter()
    assert len(got) == df.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mixed_rows(df).columns == df.columns


def test_license_scan(docs):
    got = licenses.scan(docs).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"),
                                          ("general public license", "gpl"))
              for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
             ",".join(sorted({x for _, x in at}))] += 1
    assert want == Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                            ",".join(r["base_labels"])) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["labels"] == ["apache", "apache-2.0", "mit"]
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in got)


def test_license_suppression_and_rules(spark):
    rules = licenses.rules()
    assert len(rules) > 200
    assert all(any(g in r["regex"] + r["keyword"] for g in licenses.GATE) or r["kind"] in ("text", "address", "name")
               for r in rules)
    df = spark.createDataFrame([(1, "under the GNU Lesser General Public License version 2.1 or " * 3)],
                               "doc_id long, text string")
    scanned = licenses.scan(df)
    row = scanned.first()
    assert row["labels"] == ["gpl", "lgpl-2.1"] and row["n_base"] == 3 and row["n_kept"] == 3
    assert {r["label"] for r in licenses.spans(scanned).collect()} == {"lgpl-2.1"}
    assert licenses.spans(scanned).count() == row["n_kept"]


def test_license_gates_lose_nothing(spark):
    notices = [
        "released under the GPL v2", "distributed under GPL version 3", "GPLv2", "use GPLv3 or later", "LGPLv2.1",
        "AGPLv3", "This product includes software developed by the Apache Software Foundation",
        "this product includes software developed by the OpenSSL Project", "see http://mozilla.org/MPL/1.1/",
        "All advertising materials mentioning features or use of this software must display", "the X11 license",
        "All rights reserved. Copyright", "commercial license", "all rights reserved", "creativecommons.org/licenses/by",
        "Creative Commons Attribution ShareAlike 4.0", "plain words", "php.net/license/3_01", "wtfpl.net/about",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(
        list(enumerate(notices)), "doc_id long, text string")).collect()}
    for i, text in enumerate(notices):
        plain = " " + re.sub("[^0-9a-z]+", " ", text.lower()).strip() + " "
        want = {r["id"] for r in licenses.rules() if re.search(r["regex"], plain)}
        assert {d["rule"] for d in got[i]["detections"]} == want, text
    assert [got[i]["labels"] for i in range(4)] == [["gpl-2.0"], ["gpl-3.0"], ["gpl-2.0"], ["gpl-3.0"]]
    assert all(got[i]["labels"] for i in range(13)) and not got[13]["labels"]


def test_token_counts(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.piece_vocabulary(path)
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        n = missed = i = 0
        while i < len(word):
            size = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i:i + k] in known), 0)
            n += 1 if size else len(word[i].encode())
            missed += not size
            i += max(1, size)
        return n, missed

    want = Counter()
    for i, t, *_ in ROWS:
        w = (t or "").encode().split()
        c = [greedy(token_counts.MARK + x.decode()) for x in w]
        want[i, len(w), sum(x[0] for x in c), sum(x[1] for x in c)] += 1
    assert want == Counter(map(tuple, token_counts.token_counts(docs, path).collect()))


def brute_fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                label[root(b)] = root(a)
    return {v: root(v) for v in vs}


def test_simhash(docs):
    got = simhash.components(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id").collect()
    fp = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    roots = brute_components({f for _, f in fp})
    first = {}
    for i, f in fp:
        if i is not None:
            first[roots[f]] = min(i, first.get(roots[f], i))
    assert Counter((i, f"{f:016x}", first.get(roots[f])) for i, f in fp) == Counter(map(tuple, got))
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))


def test_simhash_sends_no_table_of_fingerprints_through_the_driver(docs):
    for made in (simhash.components(docs), simhash.links(simhash.components(docs).select("fp").distinct())):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 1 << 63, 40):
        values.add(int(base))
        for _ in range(12):
            v = int(base)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                v ^= 1 << int(bit)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(900, 8)), np.tile(rng.normal(size=8), (300, 1))]).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    odd = [(2000, None, 0), (2100, [0.0] * 8, 0), (2200, [float("nan")] * 8, 0), (2300, [None] * 8, 0),
           (None, [1.0] * 8, 0), (2400, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    wide = points.astype(float)
    hit = 0
    assert sorted(got) == list(range(0, 1200, 100))
    for q, found in got.items():
        gap = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        true = np.lexsort((np.arange(len(gap)), gap))[:10]
        hit += len({i for i, _, _ in found} & set(true.tolist()))
        assert [x[2] for x in found] == list(range(1, 11))
        assert all(math.isclose(s, gap[i], rel_tol=1e-12, abs_tol=1e-12) for i, s, _ in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hit >= 0.9 * 10 * len(got)
    few = neighbours.search(df.filter("vec_id < 5"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 4


def test_neighbours_of_small_leaves(spark):
    rng = np.random.default_rng(5)
    groups = np.repeat(rng.normal(size=(20, 8)), 200, axis=0)  # copies: one leaf holds all neighbours
    rows = [(i, p.tolist()) for i, p in enumerate(groups)]
    rows += [(4000 + i, [50.0 + i / 10] * 8) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") % 100 == 0).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == dict.fromkeys(range(0, 4001, 100), 10)


def test_toxicity(spark, docs, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(table, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert toxicity.clean_rows(docs, model).columns == docs.columns
    none = toxicity.fit(table, labels.limit(0))
    assert toxicity.score(docs, none).select("score").distinct().count() == 1


def test_toxicity_features():
    lexicon = toxicity.Lexicon({"blorg": 5.0})
    clean, rude = lexicon.features("a calm day at sea"), lexicon.features("An 1d!ot and YOU blorgish idiot!!")
    assert len(clean) == len(rude) == toxicity.FEATURES
    assert clean[1] == 0 and rude[1] > 0 and rude[7] > 0 and rude[10] > 0 and lexicon.features("")[0] == 0


def test_suffix_tree(docs):
    got = suffix_tree.score(docs, suffix_tree.held_out(docs)).collect()
    train = Counter()
    for i, t, *_ in ROWS:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            train.update(words(t) + [b""])
    n, v, want = sum(train.values()), len(train), []
    for i, t, *_ in ROWS:
        w = words(t) + [b""]
        want.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(w),
                     sum(train[x] > 0 for x in w), n,
                     round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert Counter(want) == Counter((*r[:5], round(r["base_score"], 5)) for r in got)
    assert all(r["score"] < 0 for r in got)


def test_language(docs, table):
    model = langid.fit(table.filter(~langid.held_out(table)))
    got = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id")
    held = got.filter(langid.held_out(got))
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    edge = {(r["doc_id"], r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in langid.predict(docs, model).collect()}
    assert {(2, True, True), (3, True, True), (13, True, True), (5, False, True)} <= edge
    nothing = langid.fit(table.limit(0))
    assert langid.predict(docs, nothing).filter("lang_pred <> 'und'").count() == 0


def check_packing(df, got, path):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    want, have = Counter(), Counter()
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] += len(ids)
        texts[r["doc_id"]].append(ids)
    for i, rows in pieces.items():
        for r in rows:
            have[i] += r["length"]
            assert any(len(ids) == r["doc_tokens"] and r["ids_crc32"] == zlib.crc32(
                np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for ids in texts[i])
    assert want == have
    return sum(have.values()) / (packing.LENGTH * len(sequences))


def test_packing(docs, table):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(docs, packing.pack(docs, path, group_bytes=100_000).collect(), path)
    assert check_packing(table, packing.pack(table, path).collect(), path) > 0.98


def test_first_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 9000, 400).tolist()
    pieces = packing.pack_lengths(lengths)
    held = Counter()
    for d, at, size, b in pieces:
        held[b] += size
    assert max(held.values()) <= packing.LENGTH and sum(held.values()) == sum(lengths)
    assert len(held) == -(-sum(lengths) // packing.LENGTH)
    bins = packing.Bins(5, 10)
    assert [bins.place(n) for n in (7, 6, 4, 3, 10)] == [0, 1, 1, 0, 2]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert exact_dedup.decide(none, exact_dedup.new_index(spark)).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert licenses.scan(none).count() == 0 and token_counts.token_counts(none, path).count() == 0
    assert simhash.components(none).count() == 0
    assert suffix_tree.score(none, suffix_tree.held_out(none)).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(vectors, F.col("vec_id") % 100 == 0).count() == 0
