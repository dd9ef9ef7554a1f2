"""Order-dependent operators that never put one key, or the whole table, in one task.

A plain window partitioned by a key sorts every row of that key in a single task, and a
window without a partition sorts the whole table in one. Here the rows are range-sorted on
(key, order) first, numbered with per-partition offsets, and cut into blocks of a fixed
number of rows. Windows then run inside blocks, and what crosses a block border travels as
a small carry table with at most one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize

ROWS_PER_BLOCK = 65536


def assign_sequence(df: DataFrame, order: list[Column], out: str = "sequence") -> DataFrame:
    """Number rows 1..n in the total order ``order`` (which must end in a unique key).

    Two passes: a range sort written to the shared folder together with each row's slot
    (partition, position), then one offset per partition. The offset table has as many rows
    as the sort has partitions, so it is always small enough to broadcast.
    """
    stored = materialize(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "sequence"
    )
    part = F.shiftright(F.col("_slot"), 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    position = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + position + 1)
        .drop("_part", "_slot", "_offset")
    )


def number(df: DataFrame, keys: list[str], order: list,
           rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``_g``, the global position in (keys, order), and ``_block``, its block number.

    Input of the functions below; they keep both columns, so a chain of them shuffles on
    (block, key) once.
    """
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    return assign_sequence(df, cols, "_g").withColumn(
        "_block", F.floor((F.col("_g") - 1) / F.lit(rows_per_block)).cast("long"))


def shifted(numbered: DataFrame, keys: list[str], outputs: dict[str, tuple[int, str]],
            rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Lag (negative offset) and lead (positive) inside each key, block by block.

    Rows close to a block border are copied into the neighbouring block as a halo, so one
    shuffle on the block number is enough.
    """
    back = max([-o for o, _ in outputs.values() if o < 0], default=0)
    ahead = max([o for o, _ in outputs.values() if o > 0], default=0)
    if max(back, ahead) >= rows_per_block:
        raise ValueError("offset must be smaller than a block")
    pos, home = F.pmod(F.col("_g") - 1, F.lit(rows_per_block)), F.col("_block")
    homes = F.filter(
        F.array(
            home,
            F.when(pos >= rows_per_block - back, home + 1) if back else F.lit(None).cast("long"),
            F.when(pos < ahead, home - 1) if ahead else F.lit(None).cast("long"),
        ),
        lambda b: b.isNotNull(),
    )
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(homes))
    w = Window.partitionBy("_block", *keys).orderBy("_g")
    made = [
        (F.lag(col, -off) if off < 0 else F.lead(col, off)).over(w).alias(name)
        for name, (off, col) in outputs.items()
    ]
    return spread.select("*", *made).filter(F.col("_block") == F.col("_home")).drop("_home")


_RUNNING = {
    "sum": (F.sum, F.sum),
    "max": (F.max, F.max),
    "last": (lambda c: F.last(c, ignorenulls=True), None),
}


def running(numbered: DataFrame, keys: list[str], outputs: dict[str, tuple[str, str]],
            rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (non-null) per key up to and including the row."""
    local = Window.partitionBy("_block", *keys).orderBy("_g").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = numbered.select(
        "*", *[_RUNNING[fn][0](col).over(local).alias(f"_l_{name}")
               for name, (fn, col) in outputs.items()])
    totals = [
        (F.max_by(col, F.when(F.col(col).isNotNull(), F.col("_g"))) if fn == "last"
         else _RUNNING[fn][1](col)).alias(f"_t_{name}")
        for name, (fn, col) in outputs.items()
    ]
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    # Only a key that touches a block border can carry anything in or out: at most two rows
    # per block are left before the carry is computed.
    at = F.pmod(F.col("_g") - 1, F.lit(rows_per_block))
    carry = (
        numbered.groupBy("_block", *keys)
        .agg(*totals, F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .filter((F.col("_lo") == 0) | (F.col("_hi") == rows_per_block - 1))
        .select("_block", *keys, F.count(F.lit(1)).over(past).alias("_earlier"),
                *[_RUNNING[fn][0](f"_t_{name}").over(past).alias(f"_c_{name}")
                  for name, (fn, _) in outputs.items()])
        .filter(F.col("_earlier") > 0)
    )
    joined = within.join(carry, ["_block", *keys], "left")
    made = []
    for name, (fn, _) in outputs.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if fn == "sum":
            made.append(F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(name))
        elif fn == "max":
            made.append(F.greatest(here, before).alias(name))
        else:
            made.append(F.coalesce(here, before).alias(name))
    return joined.select(*[F.col(c) for c in numbered.columns], *made)


def segment_runs(df: DataFrame, keys: list[str], order: list, labels: list[str],
                 out: str = "segment", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Gaps and islands: number maximal runs of equal ``labels`` per key, from 1."""
    base = number(df, keys, order, rows_per_block).withColumn("_one", F.lit(1))
    prior = {f"_p{i}": (-1, c) for i, c in enumerate(labels)}
    lagged = shifted(base, keys, {**prior, "_seen": (-1, "_one")}, rows_per_block)
    same = F.col("_seen").isNotNull()
    for i, c in enumerate(labels):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    flagged = lagged.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_seen", "_one", *prior)
    return running(flagged, keys, {out: ("sum", "_new")}, rows_per_block).drop(
        "_new", "_g", "_block")


def global_rank(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Row number in ``order`` plus competition rank and counts above/below on ``value``.

    ``order`` must start with ``value`` descending. Ranks come from the row numbers of each
    distinct value, so equal values share one rank without a single-task window.
    """
    numbered = assign_sequence(df, order, "row_rank")
    span = numbered.groupBy(value).agg(
        (F.min("row_rank") - 1).alias("above"), F.max("row_rank").alias("_last"))
    total = numbered.count()
    return (
        numbered.join(span, value)
        .withColumn("total", F.lit(total).cast("long"))
        .withColumn("below", F.col("total") - F.col("_last"))
        .withColumn("rank", F.col("above") + 1)
        .drop("_last")
    )
