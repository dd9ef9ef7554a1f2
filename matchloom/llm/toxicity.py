"""Toxicity by gradient-boosted trees over dense features with isotonic calibration (operator 7).

Features of a whole text: densities of a small written lexicon and of stems learned from the training
labels, their closeness to second-person words, capitals, punctuation, and how much looks
obfuscated. The trees and the isotonic curve are Spark ML models.

The fit uses at most ``LABELLED`` training rows, chosen by hash: half of them for the stems, two fifths for
the trees and a tenth for the calibration, so that each part is fitted on rows the one
before has not seen. The sample's ids are broadcast (at most ``LABELLED`` rows); the text
of all documents is never shuffled. Scoring is a projection.

Defined cases: null and empty texts have no words and get the score of such a text; labels that are null
or belong to no document are ignored, a document labelled more than once counts as toxic if any
label says so; if the training rows do not hold both classes, the score is their smoothed
share; a null doc_id counts as empty text in the hold-out rule; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import remainder, text_of
from matchloom.session import materialize

LABELLED = 20_000
THRESHOLD = 0.3
SEED = 7
TREES, DEPTH, STEP = 20, 3, 0.3
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
MOST_STEMS = 1000
LEAST_DOCS, LEAST_ODDS = 3, 3.0
NEAR = 5
REMEMBERED = 500_000

INSULTS = frozenset("""idiot idiots moron morons stupid dumb loser losers trash scum clown clowns worthless
    pathetic disgusting imbecile fool fools jerk jerks creep creeps pig pigs filth filthy garbage vermin
    rat rats coward cowards liar liars ugly retard retarded dimwit halfwit nitwit degenerate degenerates
    dummkopf trottel arschloch abschaum drecksau schwachkopf connard crétin imbécile ordure salaud
    estúpido imbécil basura idiota escoria cabrón gilipollas tonto""".split())
THREATS = frozenset("""kill die hurt beat destroy punish strangle shoot stab burn murder töten sterben
    umbringen tuer crever mourir matar morir""".split())
COARSE = frozenset("""damn hell crap shit fuck fucking bitch bastard ass asshole bloody scheiße verdammt
    merde putain mierda joder""".split())
PERSON = frozenset("""you your yours yourself u ya du dich dir dein deine euch ihr tu te toi ton ta tes vous
    votre tú ti tus usted ustedes vosotros""".split())
LEET = str.maketrans("@4301!$57|", "aaeoiisstl")
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
MASKED = re.compile(r"[^\W\d_]+(?:[@$*!|0-9]+[^\W\d_]+)+|\b(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_]\b")
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
MARKS = b"!?*#$%&@~^|"
FEATURES = 18


class Lexicon:
    """Classes of words, with those met last remembered."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.seen: dict[str, int] = {}

    def bits(self, word: str) -> int:
        """1 insult, 2 threat, 4 coarse, 8 learned stem, 16 second person."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = (word in INSULTS) + 2 * (word in THREATS) + 4 * (word in COARSE) + 16 * (word in PERSON)
            if word + "$" in self.stems or any(word[:n] in self.stems for n in STEM_LENGTHS if n <= len(word)):
                got += 8
            self.seen[word] = got
        return got

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n = len(words)
        kinds = np.fromiter(map(self.bits, words), np.uint8, n)
        insult, threat, coarse, stem = (int(np.count_nonzero(kinds & b)) for b in (1, 2, 4, 8))
        hits = np.flatnonzero(kinds & 13)
        persons = np.flatnonzero(kinds & 16)
        close = 0
        if len(hits) and len(persons):
            right = np.searchsorted(persons, hits)
            gap = np.minimum(np.abs(persons[np.minimum(right, len(persons) - 1)] - hits),
                             np.abs(hits - persons[np.maximum(right - 1, 0)]))
            close = int((gap <= NEAR).sum())
        masked = MASKED.findall(text)
        unmasked = sum(1 for m in masked if self.bits(WORD.sub(
            lambda g: g[0], re.sub(r"[^\w]|_", "", m.lower().translate(LEET)))) & 13)
        data = text.encode()
        size = max(1, len(data))
        letters = len(data) - len(data.translate(None, LETTERS))
        capitals = len(data) - len(data.translate(None, UPPER))
        marks = len(data) - len(data.translate(None, MARKS))
        per = 100.0 / max(1, n)
        return [math.log1p(n), math.log1p(insult), insult * per, math.log1p(threat), threat * per,
                math.log1p(coarse), coarse * per, math.log1p(stem), stem * per,
                math.log1p(len({words[i] for i in hits})), math.log1p(close), close * per,
                capitals / max(1, letters), len(SHOUT.findall(text)) * per, 100.0 * marks / size,
                100.0 * data.count(b"!") / size, len(masked) * per, math.log1p(unmasked)]


def with_features(rows: DataFrame, stems: dict[str, float]) -> DataFrame:
    """Add ``features`` (array of doubles) computed from the column ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(stems)  # at most MOST_STEMS entries

    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(shared.value)
        for texts in batches:
            yield pd.Series([lexicon.features(t) for t in texts], dtype=object)

    return rows.withColumn("features", F.pandas_udf(compute, "array<double>")(F.col("text")))


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Word beginnings, or whole words (ending in $), that mark toxic rows of (text, label)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                words = set(WORD.findall(text.lower()))
                stems = {w[:n] for w in words for n in STEM_LENGTHS if n <= len(w)}
                stems |= {w + "$" for w in words}
                seen.update(stems)
                if label:
                    toxic.update(stems)
        stems = list(seen)
        for at in range(0, len(stems), 50_000):
            some = stems[at:at + 50_000]
            yield pd.DataFrame({"stem": some, "n": [seen[s] for s in some], "t": [toxic[s] for s in some]})

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    if not totals["n"]:
        return {}
    bad, good = float(totals["t"]), float(totals["n"] - totals["t"])
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))
    best = (rows.select("text", "label").mapInPandas(count, "stem string, n long, t long")
            .groupBy("stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
            .filter(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
            .orderBy(F.desc("t"), F.desc("odds"), F.length("stem"), "stem").limit(4 * MOST_STEMS).collect())
    kept: dict[str, float] = {}
    for r in best:  # a longer stem adds nothing to one of its beginnings
        stem = r["stem"]
        if len(kept) < MOST_STEMS and not any(stem[:n] in kept for n in range(3, len(stem))):
            kept[stem] = r["odds"]
    return kept


class Model:
    """Stems, trees and calibration curve; ``prior`` alone where the classes could not be told apart."""

    def __init__(self, stems, trees, curve, prior: float):
        self.stems, self.trees, self.curve, self.prior = stems, trees, curve, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` to rows with a column ``text``; ``text`` and work columns are dropped."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.prior)).drop("text")
        raw = _raw(self.trees, with_features(rows, self.stems))
        if self.curve is None:
            return raw.withColumn("score", F.col("_p")).drop("text", "_p")
        curved = self.curve.setFeaturesCol("_p").setPredictionCol("_c").transform(raw)
        score = F.lit(0.98) * F.col("_c") + F.lit(0.02) * F.col("_p")  # keeps order where the curve is flat
        return curved.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop(
            "text", "_p", "_c")


def _raw(trees, rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != "features"]
    scored = trees.transform(rows.withColumn("_vector", array_to_vector("features")))
    return scored.select(*kept, vector_to_array("_probability")[1].alias("_p"))


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """At most ``LABELLED`` rows (text, label, part) whose remainder of 4 is not 2."""
    marked = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("label"))
    marked = marked.filter(F.col("_id").isNotNull() & F.col("label").isNotNull()
                           & (remainder(F.col("_id"), 4) != 2))
    marked = marked.groupBy("_id").agg(F.max("label").alias("label"))
    sample = materialize(marked.withColumn("_h", F.xxhash64(F.lit(SEED), "_id")).orderBy("_h", "_id")
                         .limit(LABELLED), "labelled")
    part = F.pmod(F.col("_h"), F.lit(10))
    rows = docs.select(docs[id_column].cast("long").alias("_id"), text_of(docs, text_column).alias("text"))
    return materialize(rows.join(F.broadcast(sample), "_id").select(
        "text", F.col("label").cast("double").alias("label"), part.alias("part")), "training")


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    rows = training_rows(docs, labels, **columns)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("t"),
                    F.coalesce(F.sum(F.when(F.col("part").between(5, 8), F.col("label"))), F.lit(0.0)).alias("bt"),
                    F.count(F.when(F.col("part").between(5, 8), 1)).alias("bn"),
                    F.coalesce(F.sum(F.when(F.col("part") == 9, F.col("label"))), F.lit(0.0)).alias("ct"),
                    F.count(F.when(F.col("part") == 9, 1)).alias("cn")).first()
    prior = (seen["t"] + 1) / (seen["n"] + 2)
    if not 0 < seen["bt"] < seen["bn"]:
        return Model({}, None, None, prior)
    stems = learn_stems(rows.filter("part < 5"))
    ready = materialize(with_features(rows.filter("part >= 5"), stems).select("label", "part", "features"), "features")
    grower = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_class", maxIter=TREES,
                           maxDepth=DEPTH, stepSize=STEP, seed=SEED, minInstancesPerNode=2)
    trees = grower.setRawPredictionCol("_margin").setProbabilityCol("_probability").fit(ready.filter("part < 9").withColumn("_vector", array_to_vector("features")))
    curve = None
    if 0 < seen["ct"] < seen["cn"]:
        held = _raw(trees, ready.filter("part = 9"))
        curve = IsotonicRegression(featuresCol="_p", labelCol="label").fit(held)
    return Model(stems, trees, curve, prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    return model.score(rows).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_rows(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = f"_c{names.index(text_column)}"
    scored = model.score(plain.withColumn("text", F.coalesce(F.col(at).cast("string"), F.lit(""))))
    return scored.filter(F.col("score") < THRESHOLD).drop("score").toDF(*names)


def held_out(docs: DataFrame, id_column: str = "doc_id"):
    return remainder(docs[id_column], 4) == 2
