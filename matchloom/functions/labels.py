"""Labels and outcomes as Column expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names in display order, and the spellings of each outcome.
COLOUR_NAMES = ["Amber", "Amethyst", "Emerald", "Ruby", "Sapphire", "Steel"]
OUTCOMES = {"win": ["win", "won"], "loss": ["loss", "lost"], "draw": ["draw", "tie"]}
OUTCOME_NAMES = ["win", "loss", "draw", "unknown"]
COLOUR_PAIRS = ["/".join(pair) for pair in combinations(COLOUR_NAMES, 2)]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_outcome(result) -> Column:
    text = F.lower(F.trim(F.coalesce(_col(result), F.lit(""))))
    out = F
    for name, spellings in OUTCOMES.items():
        out = out.when(text.isin(spellings), name)
    return out.otherwise("unknown")


def _titles(colours: Column) -> Column:
    """Each name in title case: a letter is upper case after anything that is no letter."""
    def title(c):
        apart = F.regexp_replace(F.trim(c.cast("string")), r"([^\p{L}])", "$1\u0001 ")
        return F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))

    return F.transform(colours, title)


def color_pair(colours) -> Column:
    """Known colours in display order; anything else, or nothing, is ``Unknown``."""
    c = _col(colours)
    known = F.array(*[F.lit(n) for n in COLOUR_NAMES])
    titles = _titles(c)
    strange = F.size(F.array_except(titles, known)) > 0
    label = F.array_join(F.filter(known, lambda k: F.array_contains(titles, k)), "/")
    return F.when(c.isNull() | (F.size(c) == 0) | strange, "Unknown").otherwise(label)


def colors_label(colours) -> Column:
    """Alphabetical label without a membership check."""
    c = _col(colours)
    return F.when(c.isNull() | (F.size(c) == 0), "Unknown").otherwise(
        F.array_join(F.array_sort(F.array_distinct(_titles(c))), "/"))


def queue_label() -> Column:
    """Format, queue name, match format and ranked state from the queue columns."""
    def filled(c):
        return F.when(F.col(c) != "", F.col(c))
    evidence = F.lower(F.concat_ws(
        " ", F.coalesce("queue_id", F.lit("")), F.coalesce("queue_name", F.lit(""))))
    tokens = F.regexp_extract_all(evidence, F.lit("[a-z]+"), F.lit(0))
    core, infinity = F.array_contains(tokens, "core"), F.array_contains(tokens, "infinity")
    kind = F.when(infinity & ~core, "Infinity").when(core & ~infinity, "Core").otherwise(
        "Format unknown")
    ranked = F.when(F.col("ranked"), "ranked").when(~F.col("ranked"), "unranked").otherwise(
        "rank unknown")
    name = F.coalesce(filled("queue_name"), filled("queue_id"), filled("mode"),
                      F.lit("Unknown queue"))
    return F.concat_ws(" · ", kind, name,
                       F.coalesce(filled("match_format"), F.lit("match format unknown")), ranked)


def wld_record(outcome: Column) -> list[Column]:
    """Win, loss, draw and unknown counts plus win share over decided and drawn games."""
    def n(name):
        return F.sum(F.when(outcome == name, 1).otherwise(0))
    total = n("win") + n("loss") + n("draw")
    return [n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"),
            n("unknown").alias("unknown"), F.count(F.lit(1)).alias("games"),
            F.when(total > 0, 100.0 * n("win") / total).alias("win_percentage")]
