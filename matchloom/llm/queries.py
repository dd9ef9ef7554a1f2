"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import (alignment, exact_dedup, fingerprints, langid, licenses, mixing, neighbours, packing, periodic_runs,
                           simhash, suffix_tree, token_counts, toxicity)
from matchloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decide(table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))
    return rows.select("doc_id", "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_finish")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join("labels", ",").alias("labels"), "score", "n_kept")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id",
                       "group_size")


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_tree.score(docs, suffix_tree.held_out(docs))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(docs)))
    return langid.predict(docs, model).select(
        "doc_id", (langid.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    rows = periodic_runs.find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = rows.withColumn("_best", longest).withColumn("_lines", lines)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("_lines", "\n"), F.when(F.size("_lines") > 0, F.lit("\n")).otherwise("")).cast(
            "binary"), 256).alias("runs_sha256"),
        F.coalesce(F.sha2(F.col("collapsed").cast("binary"), 256), "words_sha256").alias("collapsed_sha256"), "n_words")


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


ORACLE = {"op1_exact_dedup": r"""
    with d as (
        select doc_id, length(coalesce(text, '')) as n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
        from documents
    ), r as (
        select *, row_number() over (partition by text_sha256 order by n desc, doc_id nulls last) as nth,
               count(*) over (partition by text_sha256) as group_size,
               first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id
        from d
    )
    select doc_id, keep_id, group_size, (nth = 1) as kept, text_sha256 from r"""}
