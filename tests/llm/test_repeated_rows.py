"""Rows equal in id and text: spread over blocks and groups, and none of their variants lost."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from matchloom.llm import langid, mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_mix_keeps_variants_of_equal_rows(spark):
    rows = [(1, "a b c", "x", "en"), (1, "a b c", "x", "de"), (1, "a b c", "x", "fr"), (2, "d e f g", "y", "en"), (3, "h", None, "en"),
            (None, "i j", "z", "en"), (None, "i j", "z", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = {r["source"]: [x["taken"] for x in mixing.mix(docs).filter(F.col("source").eqNullSafe(F.lit(r["source"]))).collect()]
             for r in docs.select("source").distinct().collect()}
    got = mixing.mixed_rows(docs).collect()
    times = Counter((r.doc_id, r.text, r.source, r.lang) for r in got)
    for i, t, s, _ in set(rows):
        copies = [times[r] for r in rows if r[:3] == (i, t, s)]
        assert max(copies) - min(copies) <= 1
    want = sum(int(x / 3 + 0.5) for x in taken["x"])
    assert sum(n for (i, *_), n in times.items() if i == 1) == want


def test_equal_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, None, "s")] * 3000 + [(7, "w " * 50, "s")] * 3000, "doc_id long, text string, source string").repartition(4)
    queue = mixing.shuffled_queue(docs)
    assert queue.count() == 6000
    assert queue.filter("size > 0").select("cum_end").distinct().count() == 3000
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] == 150_000
    pieces = packing.pack(docs, PATH, group_bytes=20_000)
    per_group = pieces.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_group) > 5 and max(r.n for r in per_group) < 2500
    assert pieces.count() >= 6000


def test_language_fit_reads_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS_PER_LANGUAGE", 5)
    texts = {"en": "the house and the garden were quiet", "de": "das haus und der garten waren still", "fr": "la maison et le jardin"}
    rows = [(i, f"{texts[k]} {i}", k, "x") for i in range(200) for k in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `TEXT` string")
    model = langid.fit(docs)
    assert model.names == ["de", "en", "fr"]
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = langid.predict(plain, model).join(plain.select("doc_id", "lang"), "doc_id")
    assert langid.predict(plain, model).filter("rejected").count() < 20
    right = sum(model.predict([t])[0][0] == k for _, t, k, _ in rows)
    assert right == len(rows) and got.count() == len(rows) * 3
