"""Game-history documents with loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.times import parse_timestamp

TEXTS = ["game_id", "match_id", "match_format", "mode", "queue_id", "queue_name", "season_id",
         "season_name", "result", "replay_id", "replay_url", "opp_display_name"]
INTEGERS = ["match_game_number"]
FLAGS = ["ranked", "went_first"]
TIMES = ["started_at", "ended_at"]
COLOURS = ["your_deck_colors", "opp_deck_colors"]
FIELDS = TEXTS + INTEGERS + FLAGS + TIMES + COLOURS


def _value(field: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{field}', 'string')")


def _kind(field: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get(v, '$.{field}', 'variant'))")


def optional_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def parse_history(docs: DataFrame) -> DataFrame:
    """One typed row per document; ``errors`` names the fields that cannot be read.

    Integers reject booleans, booleans accept 0 and 1, times need a zone or an epoch value,
    colours are a list or slash-separated text. Bad rows stay, with their errors.
    """
    # Parsed once; every field is then read from the variant, which also knows its kind.
    rows = docs.withColumn("v", F.try_parse_json("body"))
    errors, cols = [], []
    for f in TEXTS:
        cols.append(optional_text(_value(f)).alias(f))
    errors.append(F.when(F.col("v").isNull(), "document").when(
        optional_text(_value("game_id")).isNull(), "game_id"))
    for f in INTEGERS:
        value = _value(f)
        number = F.expr(f"try_cast(try_variant_get(v, '$.{f}', 'string') as int)")
        boolean = F.coalesce(_kind(f) == "BOOLEAN", F.lit(False))
        cols.append(F.when(~boolean, number).alias(f))
        errors.append(F.when(value.isNotNull() & (boolean | number.isNull()), f))
    for f in FLAGS:
        value = _value(f)
        quoted = F.coalesce(_kind(f) == "STRING", F.lit(False))
        flag = F.when(~quoted & value.isin("true", "1"), True).when(
            ~quoted & value.isin("false", "0"), False)
        cols.append(flag.alias(f))
        errors.append(F.when(value.isNotNull() & flag.isNull(), f))
    for f in TIMES:
        text = optional_text(_value(f))
        moment = parse_timestamp(text)
        cols.append(moment.alias(f))
        errors.append(F.when(text.isNotNull() & moment.isNull(), f))
    for f in COLOURS:
        value, kind = _value(f), _kind(f)
        items = F.when(kind == "STRING", F.split(value, "/")).when(
            kind.startswith("ARRAY"), F.from_json(value, "array<string>"))
        clean = F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")
        textual = kind.isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>")
        cols.append(F.when(textual, clean).alias(f))
        errors.append(F.when(value.isNotNull() & ~F.coalesce(textual, F.lit(False)), f))
    return rows.select(
        *[c for c in docs.columns], *cols,
        F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"))


def parse_history_pages(pages: DataFrame) -> DataFrame:
    """Provider pages (``page``: JSON with ``games`` and ``next_cursor``) to one row per game.

    A page without a proper games list gives one row with an error and no body.
    """
    v = pages.withColumn("_v", F.try_parse_json("page"))
    games = F.expr("try_variant_get(_v, '$.games', 'array<variant>')")
    cursor = F.expr("try_variant_get(_v, '$.next_cursor', 'string')")
    rows = v.withColumn("_games", games).withColumn("next_cursor", F.when(cursor != "", cursor))
    objects = F.forall("_games", lambda g: F.schema_of_variant(g).startswith("OBJECT"))
    bad = F.col("_games").isNull() | ~objects
    rows = rows.withColumn("error", F.when(bad, "invalid_games"))
    kept = [c for c in pages.columns if c != "page"]
    return rows.select(
        *kept, "next_cursor", "error", F.posexplode_outer(F.when(~bad, F.col("_games")))
        .alias("position", "_game")).filter(F.col("error").isNotNull() | F.col("_game").isNotNull()).select(
        *kept, "next_cursor", "error", "position", F.to_json("_game").alias("body"))
