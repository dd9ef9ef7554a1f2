"""Mixing sources to target weights by weighted fair queueing (operator 2).

Documents of a source are shuffled by a hash. A document's virtual finish time is the number of
words of its source up to and with it, divided by the source's target; further passes over
a source continue the count. All queue entries are sorted by finish time over the whole table and the
queue is cut where its running total reaches the budget, the sum of the targets. The document
that a source has in service at its target is queued in two parts, so that every source
arrives at its target to the word.

The running count inside a source is made of two levels: documents fall in blocks of about
``ROWS_PER_BLOCK`` rows by their shuffle hash, windows run inside a block, and what lies before a
block is a window over one row per block. So a source that holds a third of all rows is spread like
the rest. The table of sources has one row per source and that of blocks one per 4,096 documents.

Defined cases. A null text has no words; a null source is a source of its own, ranked last; documents
without words are never taken; repeated rows are documents of their own. An empty
table gives an empty result. Reruns agree, as the order depends on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import row_keys, text_of
from matchloom.operators.ordered import number, running
from matchloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
ROWS_PER_BLOCK = 4096
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most_passes: int = MOST_PASSES) -> DataFrame:
    """Targets from (source, source_size): rank, target (double) and quota (whole words).

    Sources in code point order, null last, take the weights in turn and share all
    words. A target above ``most_passes`` times the source's size is cut to that and the rest goes
    to the others by weight. The cut sources are those with the smallest cap per weight, so one
    ordered pass finds the share per weight at which the others settle.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most_passes))
    ordered = Window.orderBy(F.col("_cap") / F.col("_weight"), "rank")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    shared = ranked.withColumn(
        "_share", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("_weight").over(onward))
    open_ = F.col("_cap") >= F.col("_share") * F.col("_weight")
    settled = shared.withColumn("_level", F.min(F.when(open_, F.struct(
        (F.col("_cap") / F.col("_weight")).alias("c"), "rank", "_share"))).over(whole))
    target = F.least("_cap", F.coalesce(F.col("_level._share") * F.col("_weight"), F.col("_cap")))
    return settled.select("source", "source_size", "rows", "rank", target.alias("target")).withColumn(
        "quota", F.floor(F.col("target") + 1e-6).cast("long"))


def numbered_copies(rows: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Add ``_nth``: 1, 2, ... for rows equal in id, text and source, so that equal rows are spread too."""
    keys = ["_rid", "_rhash", "_has", "_name"]
    named = rows.withColumn("_has", F.col("source").isNotNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    placed = number(named.withColumn("_one", F.lit(1)), keys, [*keys, *order], ROWS_PER_BLOCK)
    return running(placed, keys, {"_nth": ("sum", "_one")}, ROWS_PER_BLOCK).select(*rows.columns, "_nth")


def shuffled_queue(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   source_column: str = "source") -> DataFrame:
    """Every row with its size, its source's figures and the words of its source before and with it."""
    text = text_of(docs, text_column)
    base = materialize(docs.select(
        docs[id_column].cast("long").alias("doc_id"), *row_keys(docs, id_column, text_column),
        docs[source_column].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    base = numbered_copies(base).withColumn("_u", F.xxhash64(F.lit(SEED), "_rid", "_rhash", "_nth"))
    sources = materialize(source_targets(base.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))), "sources")
    ranked = base.join(sources, base["source"].eqNullSafe(sources["source"])).select(
        base["*"], "rank", "source_size", "target", "quota",
        F.ceil(F.col("rows") / ROWS_PER_BLOCK).cast("long").alias("_blocks"))
    unit = F.col("_u").cast("double") / F.lit(float(1 << 64)) + 0.5
    placed = ranked.withColumn(
        "_block", F.least(F.floor(unit * F.col("_blocks")), F.col("_blocks") - 1)).drop("_blocks")
    blocks = placed.groupBy("rank", "_block").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select(
        "rank", "_block", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before")), "blocks")
    inside = Window.partitionBy("rank", "_block").orderBy("_u", "_rid", "_rhash", "_nth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    queue = placed.join(blocks, ["rank", "_block"]).withColumn(
        "cum_end", F.col("_before") + F.sum("size").over(inside))
    return materialize(queue.select(
        "doc_id", "_rid", "_rhash", "source", "size", "source_size", "target", "quota", "rank",
        (F.col("cum_end") - F.col("size")).alias("cum_start"), "cum_end"), "queue")


def _parts(most_passes: int):
    """Queue entries of a document: (finish, rank, cum, words), two for the one cut by the quota."""
    def entry(start, end):
        return F.struct((end / F.col("target")).alias("finish"), F.col("rank").cast("int").alias("rank"),
                        end.cast("long").alias("cum"), (end - start).cast("long").alias("words"))

    parts = []
    for n in range(most_passes):
        start = F.col("source_size") * n + F.col("cum_start")
        end = F.col("source_size") * n + F.col("cum_end")
        cut = F.least(F.greatest(start, F.col("quota")), end)
        parts += [entry(start, cut), entry(cut, end)]
    queued = F.filter(F.array(*parts), lambda p: p["words"] > 0)
    return F.when(F.col("quota") > 0, queued).otherwise(F.array().cast(
        "array<struct<finish:double,rank:int,cum:bigint,words:bigint>>"))


def _cut(entries: DataFrame, order: list[str], budget: int):
    """The last entry of the queue whose running total is within the budget, or None.

    First the sort partition is found, then the block of 4,096 rows in it, then the row; each step
    looks at one row per partition, per block of one partition, and per row of one block.
    """
    before, rows, last = 0, entries, None
    for bits in (33, 12, 0):
        key = F.shiftright("_slot", bits)
        sums = rows.groupBy(key.alias("_key")).agg(
            F.sum("words").alias("_words"), F.max(F.struct(*order)).alias("_last"))
        running = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("_to", F.sum("_words").over(running) + F.lit(before))
        within = sums.filter(F.col("_to") <= budget).orderBy(F.desc("_key")).limit(1).first()
        beyond = sums.filter(F.col("_to") > budget).orderBy("_key").limit(1).first()
        last = within["_last"] if within else last
        if beyond is None:
            return last
        before = within["_to"] if within else before
        rows = rows.filter(key == beyond["_key"])
    return last


def mix(docs: DataFrame, most_passes: int = MOST_PASSES, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of ``docs``: sizes, its source's target and the words taken of it.

    ``taken`` counts every pass; ``first_finish`` orders the documents of the mix.
    """
    queue = shuffled_queue(docs, id_column, text_column, source_column)
    parts = queue.withColumn("_parts", _parts(most_passes))
    order = ["finish", "rank", "cum"]
    entries = materialize(parts.select(F.explode("_parts").alias("p")).select("p.*")
                          .orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "entries")
    budget = queue.select("rank", "quota").distinct().agg(F.sum("quota")).first()[0] or 0
    cut = _cut(entries, order, budget)
    if cut is None:
        inside = F.lit(False)
        kept = F.filter("_parts", lambda p: inside)
    else:
        last = F.struct(F.lit(cut["finish"]).cast("double"), F.lit(cut["rank"]).cast("int"),
                        F.lit(cut["cum"]).cast("long"))
        kept = F.filter("_parts", lambda p: F.struct(p["finish"], p["rank"], p["cum"]) <= last)
    taken = F.aggregate("_kept", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return parts.withColumn("_kept", kept).select(
        "doc_id", "_rid", "_rhash", "source", "size", "source_size", "target", taken.alias("taken"),
        F.array_min(F.transform("_kept", lambda p: p["finish"])).alias("first_finish"))


def mixed_rows(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    Whole documents only: the one a source had in service at the cut stays if at least half
    of it was taken.
    """
    taken = mix(docs, **columns).filter("size > 0").withColumn(
        "_times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    names = docs.columns
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values())
    id_column, text_column = columns.get("id_column", "doc_id"), columns.get("text_column", "text")
    keyed = plain.select("*", *row_keys(plain, at[id_column], at[text_column]))
    # rows equal in id, text and source share their takes, one each in turn; they may differ in other columns
    times = materialize(taken.groupBy("_rid", "_rhash", F.col("source").alias("_source")).agg(
        F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_copies")).filter("_times > 0"), "times")
    source = F.col(at[columns.get("source_column", "source")]).cast("string")
    rows = keyed.withColumn("source", source).withColumn("_has", source.isNotNull()).withColumn(
        "_name", F.coalesce(source, F.lit("")))
    times = times.withColumn("_has", F.col("_source").isNotNull()).withColumn(
        "_name", F.coalesce("_source", F.lit(""))).drop("_source")
    joined = rows.join(times, ["_rid", "_rhash", "_has", "_name"])
    single = joined.filter("_copies = 1").withColumn("_nth", F.lit(1).cast("long"))
    repeated = materialize(joined.filter("_copies > 1"), "repeated")
    if not repeated.isEmpty():
        single = single.unionByName(numbered_copies(repeated).select(*single.columns))
    share = F.floor(F.col("_times") / F.col("_copies")) + F.when(
        F.col("_nth") <= F.col("_times") % F.col("_copies"), 1).otherwise(0)
    dealt = single.withColumn("_share", share.cast("int")).filter("_share > 0")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_share")))).select(
        *at.values()).toDF(*names)
