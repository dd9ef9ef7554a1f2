"""Piecewise hashes against a plain version, byte by byte, and the walk over neighbours against a loop."""

import hashlib
import random

import pytest

from matchloom.llm import fingerprints as fp
from matchloom.llm import queries

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_fingerprint(text):
    data = text.encode()
    if not data:
        return "1::"
    hashes = []
    for i in range(len(data)):
        window = [data[i - j] if i >= j else 0 for j in range(7)]
        total = sum(window) + sum((7 - j) * c for j, c in enumerate(window))
        shifted = 0
        for j, c in enumerate(window):
            shifted ^= c << 5 * j if 5 * j < 32 else 0
        hashes.append((total + (shifted & 0xFFFFFFFF)) & 0xFFFFFFFF)

    def borders(level):
        size = fp.block_size(level)
        return [i for i, h in enumerate(hashes) if (h + 1) % size == 0]

    level = next((k for k in range(32, -1, -1) if len(borders(k)) >= 32), 0)

    def signature(level):
        ends = sorted({*[i + 1 for i in borders(level)], len(data)})
        if len(ends) > 128:
            ends = ends[:127] + ends[-1:]
        out = ""
        for a, b in zip([0] + ends, ends):
            total = 0
            for h in hashes[a:b]:
                m = h * 0xBF58476D1CE4E5B9 & MASK
                m ^= m >> 29
                m = m * 0x94D049BB133111EB & MASK
                total += m ^ m >> 32
            value = (total & MASK) * 0x9E3779B97F4A7C15 & MASK
            out += fp.LETTERS[value >> 58] + fp.LETTERS[value >> 52 & 63]
        return out

    return f"{fp.block_size(level)}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    sizes = [fp.block_size(k) for k in range(36)]
    x = {sizes.index(int(p)) + n: s for n, s in enumerate(x)}
    y = {sizes.index(int(q)) + n: s for n, s in enumerate(y)}
    for level in sorted(set(x) & set(y))[:1]:
        s, t = ([z[i:i + 2] for i in range(0, len(z), 2)] for z in (x[level], y[level]))
        row = list(range(len(t) + 1))  # edit distance by insertions and deletions
        for i, c in enumerate(s, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(row[j - 1] if c == d else 1 + min(row[j], new[j - 1]))
            row = new
        if s and t:
            best = 1 - row[-1] / (len(s) + len(t))
    return best


def some_texts():
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    out = ["", "a", "abc", "é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 5000, "ab" * 4000, "\0\0\0x", "日本語" * 50]
    out += [" ".join(r.choice(words) for _ in range(n)) for n in (3, 10, 20, 60, 200, 1000, 6000)]
    return out


def test_fingerprints_equal_the_plain_version():
    texts = some_texts()
    want = [plain_fingerprint(t) for t in texts]
    assert fp.fingerprints_of(texts) == want
    assert [fp.fingerprints_of([t])[0] for t in texts] == want
    assert fp.fingerprints_of([""]) == ["1::"] and fp.fingerprints_of([]) == []
    for a in want:
        for b in want:
            assert fp.likeness(a, b) == pytest.approx(plain_likeness(a, b))


def test_edits_lower_the_likeness_little():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    for n in (30, 100, 400, 3000, 20_000):
        text = [r.choice(words) for _ in range(n)]
        other = " ".join(r.choice(words) for _ in range(n))
        inserted = " ".join(text[:n // 2] + ["unheard", "of"] + text[n // 2:])
        a, b, c, d = fp.fingerprints_of([" ".join(text), inserted, fp.edited(" ".join(text), other), other])
        assert fp.likeness(a, b) > 0.7
        assert 0.5 < fp.likeness(a, c) < 0.95
        assert fp.likeness(a, d) < 0.3


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        text, then = text or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        new = text[:len(text) - cut] + then[:cut]
        f, e, g = plain_fingerprint(text), plain_fingerprint(new), plain_fingerprint(then)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), f, e,
                    round(plain_likeness(f, e), 12), round(plain_likeness(f, g), 12)))
    return out


def found(df):
    return [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, df.collect())]


@pytest.mark.parametrize("parts,stretch", [(1, 2_000_000), (7, 500)])
def test_walk_equals_a_loop(spark, monkeypatch, parts, stretch):
    monkeypatch.setattr(fp, "STRETCH_CHARS", stretch)
    r = random.Random(2)
    rows = [(i, t) for i, t in enumerate(some_texts()[:14])] + [(100, None)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, `TEXT` string").repartition(parts)
    assert sorted(found(fp.compared_with_next(docs))) == sorted(brute(rows))


def test_repeated_rows_null_ids_single_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(None, "one two three four")] * 9 + [(4, "one two three four")], "doc_id long, text string")
    got = found(fp.compared_with_next(same))
    assert len(got) == 10 and {g[6] for g in got} == {1.0}
    assert len({g[2] for g in got}) == 1
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert found(fp.compared_with_next(one)) == brute([(1, "abcdefgh")])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compared_with_next(none).collect() == [] and fp.fingerprints(none).collect() == []
    assert [r.fingerprint for r in fp.fingerprints(one).collect()] == [plain_fingerprint("abcdefgh")]


def test_query_tells_edits_from_strangers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {g[0]: g for g in found(queries.QUERIES["op13_fingerprints"](spark, SF))}
    short = [d for d in docs if len(d.text or "") < 4000]
    assert len(got) == len(docs)
    order = sorted(d.doc_id for d in docs)
    text = {d.doc_id: d.text or "" for d in docs}
    for d in short[:60]:
        then = text[order[(order.index(d.doc_id) + 1) % len(order)]]
        g = got[d.doc_id]
        assert g[1] == len(text[d.doc_id])
        assert g[2] == hashlib.sha256(fp.edited(text[d.doc_id], then).encode()).hexdigest()
        assert g[3] == plain_fingerprint(text[d.doc_id])
    plain = [g for i, g in got.items() if g[1] >= 100]
    assert sum(g[5] > 0.5 for g in plain) >= 0.97 * len(plain)
    assert sum(g[6] < 0.3 for g in plain) >= 0.9 * len(plain)
