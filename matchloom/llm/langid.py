"""Language ID by nearest centroid (operator 9).

A text becomes a TF-IDF vector of its byte n-grams (letters only), hashed to a fixed number of dimensions
and normalised. Each language is described by several centroids, found by spherical k-means on a
bounded sample of its training documents, and a text gets the language of the centroid with the largest
cosine. A text whose best cosine lies well below what nearly all training documents of that language
reach, leaving out those that made the centroids, is marked as rejected.

Document frequencies are counted over all training documents, a vector per task. The centroids take at most
``DOCS_PER_LANGUAGE`` training documents of a language, chosen by hash, and the bound of rejection as many others: first
the documents of each language are counted, then only those whose hash lies in the first few thousand are read, ordered
and written, so no task sees more of them. Each language is fitted in its own task. The model has ``CENTROIDS`` vectors
per language. Prediction is a projection over whole texts without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a
language are never learned from; with nothing to learn from everything is ``und``; a null doc_id
counts as empty text in the hold-out rule; repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import picked, remainder, text_of
from matchloom.session import materialize

DOCS_PER_LANGUAGE = 400
CENTROIDS = 3
BITS = 13
DIMENSIONS = 256 + (1 << BITS)
TEMPERATURE = 0.05
REJECTED_SHARE = 0.01
OVERDRAWN = 4  # documents whose hashes are looked at for each one taken
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")
CHUNK = 1 << 20


def term_counts(text: str) -> np.ndarray:
    """Counts of the bytes and of the hashed byte trigrams of the lower-cased words.

    What is no letter counts as a space, so that marks and layout, which no language owns, have no part.
    """
    data = np.frombuffer((" " + NO_LETTER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK + 2]
        out[:256] += np.bincount(part[:CHUNK], minlength=256)
        if len(part) > 2:
            wide = part.astype(np.uint32)
            code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
            out[256:] += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        counts = term_counts(text)
        seen = counts > 0
        row[seen] = (1 + np.log(counts[seen])) * idf[seen]
        row /= max(np.linalg.norm(row), 1e-12)
    return out


def spherical_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by cosine, started at points far from each other; fixed for fixed input."""
    chosen = [points.mean(axis=0)]
    while len(chosen) < min(k, len(points)) + 1:
        near = np.max(points @ np.array(chosen).T, axis=1)
        chosen.append(points[int(np.argmin(near))])
    centres = np.array(chosen[1:])
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.array([points[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c]
                         for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Languages:
    names: list[str]
    owner: np.ndarray  # language of each centroid
    centres: np.ndarray
    least: np.ndarray  # cosine below which a text of a language is rejected
    idf: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.names or not lettered:
            return out
        for at in range(0, len(lettered), 512):
            some = lettered[at:at + 512]
            near = vectors([texts[i] for i in some], self.idf) @ self.centres.T
            best = np.full((len(some), len(self.names)), -1.0)
            for c, language in enumerate(self.owner):
                best[:, language] = np.maximum(best[:, language], near[:, c])
            lang = best.argmax(axis=1)
            top = best.max(axis=1)
            share = 1 / np.exp((best - top[:, None]) / TEMPERATURE).sum(axis=1)
            for i, l, s, c in zip(some, lang, share, top):
                out[i] = (self.names[l], float(s), bool(c < self.least[l]))
        return out


def fit(docs: DataFrame, lang_column: str = "lang", id_column: str = "doc_id",
        text_column: str = "text") -> Languages:
    """Learn from the given training rows."""
    plain = picked(docs, lang=lang_column, doc_id=id_column, text=text_column)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain.select(F.col("lang").cast("string").alias("lang"), text.alias("text"),
                        F.xxhash64("doc_id", text).alias("_h")).filter(F.col("lang").isNotNull() & (F.col("text") != ""))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    unit = F.col("_h").cast("double") / F.lit(float(1 << 64)) + 0.5
    # one row per language, as the model has; without the hint all texts would be dealt by language first
    drawn = rows.join(F.broadcast(sizes), "lang").filter(unit * F.col("_rows") <= 2 * OVERDRAWN * DOCS_PER_LANGUAGE).drop("_rows")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sample = materialize(drawn.withColumn("_n", nth).filter(F.col("_n") <= 2 * DOCS_PER_LANGUAGE).select(
        "lang", "text", (F.col("_n") % 2 == 0).alias("aside")), "language-sample")

    def seen_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                df += term_counts(t) > 0
            n += len(batch)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], n)})

    seen = {r["at"]: r["n"] for r in rows.select("text").mapInPandas(seen_in, "at int, n long").groupBy("at").agg(
        F.sum("n").alias("n")).collect()}  # one number per dimension
    total = seen.pop(-1, 0)
    if not total:
        return Languages([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), np.zeros(0), np.ones(DIMENSIONS))
    df = np.zeros(DIMENSIONS)
    df[list(seen)] = list(seen.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        points, other = (vectors(group.loc[group["aside"] == a, "text"].tolist(), idf) for a in (False, True))
        centres = spherical_means(points, CENTROIDS)
        own = np.max((other if len(other) else points) @ centres.T, axis=1)  # documents that made no centroid
        low, middle = np.quantile(own, [REJECTED_SHARE, 0.5])
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tolist() for c in centres],
                             "least": float(low - (middle - low) / 2 - 1e-4)})  # and what rounding may take

    found = sorted(sample.groupBy("lang").applyInPandas(
        centre, "lang string, centre array<float>, least double").collect())
    names = sorted({r["lang"] for r in found})
    return Languages(names, np.array([names.index(r["lang"]) for r in found]),
                     np.array([r["centre"] for r in found], np.float32),
                     np.array([min(r["least"] for r in found if r["lang"] == n) for n in names]), idf)


def predict(docs: DataFrame, model: Languages, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred (the nearest), score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some vectors per language

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score", "rejected"])

    guessed = F.pandas_udf(guess, "lang_pred string, score double, rejected boolean")
    return docs.select(docs[id_column].cast("long").alias("doc_id"),
                       guessed(text_of(docs, text_column)).alias("_g")).select("doc_id", "_g.*")


def held_out(docs: DataFrame, id_column: str = "doc_id"):
    return remainder(docs[id_column], 3) == 1
