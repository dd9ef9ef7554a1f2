"""License scans with ordered signature rules (operator 3, DataFrame functions only).

The text is reduced to lower-case words. A gate of a few substrings lets most documents pass
untouched; in the others each rule's keywords are looked for before its regex runs. Gate and keywords are read
off the regexes, so they lose no match. A rule marks
its matches in the text, and the word positions of the marks give intervals. Intervals are
sorted by start, longest first; one that lies inside an earlier interval of the same or a higher
priority is suppressed. Sorted like that, all intervals that can contain another come before it, so
one running maximum per priority decides, in a single pass and without pairs.

Everything is a projection: no shuffle, no join, and a document is one row in one task whatever
its key. Defined cases: null and empty texts have no words and no detections; only A-Z are
lower-cased, other letters count as they stand; repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import text_of
from matchloom.llm.license_rules import GATE, KINDS, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OPEN, CLOSE = "\x01", "\x02"  # never part of a word
RULE = ("array<struct<id:int,kind:string,label:string,keywords:array<string>,regex:string,priority:int,"
        "confidence:double>>")
DETECTION = ("array<struct<start:int,before:int,priority:int,rule:int,kind:string,label:string,"
             "confidence:double>>")
LEVELS = sorted({p for p, _ in KINDS.values()})


def words_of(text: Column) -> Column:
    """The words, lower-cased in A-Z, with one space before, between and after them."""
    low = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, OTHER, " "), F.lit(" ")), F.lit(" "))


def _spans(words: Column, rule: Column) -> Column:
    marked = F.split(F.btrim(F.regexp_replace(
        words, rule["regex"], F.lit(OPEN + "$0" + CLOSE)), F.lit(" ")), " ")

    def at(found):
        return F.filter(F.transform(marked, lambda w, i: F.when(found(w), i)), lambda i: i.isNotNull())

    spans = F.arrays_zip(at(lambda w: F.startswith(w, F.lit(OPEN))).alias("s"),
                         at(lambda w: F.endswith(w, F.lit(CLOSE))).alias("e"))
    return F.transform(spans, lambda s: F.struct(
        s["s"].alias("start"), (-s["e"]).alias("before"), rule["priority"].alias("priority"),
        rule["id"].alias("rule"), rule["kind"].alias("kind"), rule["label"].alias("label"),
        rule["confidence"].alias("confidence")))


def detections(words: Column) -> Column:
    """All matches as structs sorted by start, longest first; ``before`` is minus the last word."""
    table = F.from_json(F.lit(json.dumps([r | {"keywords": r["keyword"].split("|")} for r in rules()])), RULE)
    tried = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(words, k)))
    return F.array_sort(F.flatten(F.transform(tried, lambda r: _spans(words, r))))


def _contained(state: Column, d: Column) -> Column:
    reach = F.element_at(state["reach"], d["priority"])
    return reach >= -d["before"]


def _resolve(found: Column) -> Column:
    """Labels, best confidence and number of the detections that are not suppressed."""
    start = F.struct(F.array(*[F.lit(-1) for _ in LEVELS]).alias("reach"),
                     F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"),
                     F.lit(0).alias("kept"))

    def step(state, d):
        inside = _contained(state, d)
        reach = F.array(*[F.when(d["priority"] <= p, F.greatest(state["reach"][p - 1], -d["before"]))
                          .otherwise(state["reach"][p - 1]) for p in LEVELS])
        return F.struct(
            reach.alias("reach"),
            F.when(inside | F.array_contains(state["labels"], d["label"]), state["labels"])
            .otherwise(F.concat(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(
                F.greatest(state["score"], d["confidence"])).alias("score"),
            (state["kept"] + F.when(inside, 0).otherwise(1)).alias("kept"))

    return F.aggregate(found, start, step)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: n_words, detections (all, sorted), labels, score, n_kept, base figures."""
    text = text_of(docs, text_column)
    low = F.lower(text)  # finds at least what lower-casing A-Z would find
    gate = F.lit(False)
    for part in GATE:
        gate = gate | F.contains(low, F.lit(part))
    none = F.array().cast(DETECTION)
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(gate, words_of(text)).alias("_words"))
    rows = rows.select("doc_id", "n_words", F.when(
        F.col("_words").isNotNull(), detections(F.col("_words"))).otherwise(none).alias("detections"))
    rows = rows.withColumn("_r", _resolve(F.col("detections")))
    base = F.filter("detections", lambda d: d["kind"] == "base")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    base_labels = F.array_distinct(F.transform(base, lambda d: d["label"]))
    return rows.select(
        "doc_id", "n_words", "detections", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_sort(base_labels).alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.col("_r.labels"))).alias("labels"),
        F.col("_r.score").alias("score"), F.col("_r.kept").cast("long").alias("n_kept"))


def spans(scanned: DataFrame) -> DataFrame:
    """The surviving detections of ``scan`` as rows (doc_id, start, end, label, kind, confidence)."""
    rows = scanned.withColumn("_row", F.monotonically_increasing_id()).select(
        "doc_id", "_row", F.inline("detections"))
    earlier = Window.partitionBy("_row").orderBy("start", "before", "priority", "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(
        F.col("priority") <= p, -F.col("before"))).over(earlier)) for p in LEVELS], F.lit(-1))
    return rows.withColumn("_reach", reach).filter(F.col("_reach") < -F.col("before")).select(
        "doc_id", "start", (-F.col("before")).alias("end"), "label", "kind", "confidence")
