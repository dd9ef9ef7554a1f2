"""Per-key selection, classification and write-side set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in ``order``.

    The ``row_number <= k`` form lets Spark keep only k rows per key on the map side
    (WindowGroupLimit), so a hot key sends k rows per task, not all of them.
    """
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (newest first, ties broken by the caller)."""
    return top_per_key(df, keys, order, 1)


def classify(rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule whose predicate is true. Predicates must not be NULL."""
    out = None
    for name, predicate in rules:
        out = F.when(predicate, name) if out is None else out.when(predicate, name)
    return out.otherwise(default)


def fails(column: Column, expected) -> Column:
    """True when the value is not ``expected``; NULL counts as failing."""
    return ~column.eqNullSafe(F.lit(expected))


def insert_ignore(target: DataFrame, updates: DataFrame, keys: list[str],
                  order: list[Column] | None = None) -> DataFrame:
    """Rows of ``target`` plus the first update of every key the target lacks."""
    fresh = latest_per_key(updates, keys, order) if order else updates.dropDuplicates(keys)
    return target.unionByName(fresh.join(target, keys, "left_anti").select(*target.columns))


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str],
                 rules: dict[str, str], order: list[Column]) -> DataFrame:
    """Upsert with one rule per column; the result is a new snapshot.

    ``overwrite`` takes the update even when NULL, ``prefer_new`` keeps the old value when
    the update is NULL, ``keep_first`` keeps the old value once it is set. ``order`` picks
    the winning update when a key occurs more than once.
    """
    new = latest_per_key(updates, keys, order)
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    new = new.select(*keys, F.struct(*[c for c in rules]).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    made = []
    for c in target.columns:
        if c in keys:
            made.append(F.col(c))
            continue
        was = F.col(f"_old.{c}")
        rule = rules.get(c)
        if rule is None:
            made.append(was.alias(c))
            continue
        now = F.col(f"_new.{c}")
        if rule == "overwrite":
            value = F.when(F.col("_new").isNotNull(), now).otherwise(was)
        elif rule == "prefer_new":
            value = F.coalesce(now, was)
        elif rule == "keep_first":
            value = F.coalesce(was, now)
        else:
            raise ValueError(f"unknown merge rule {rule!r}")
        made.append(value.alias(c))
    return joined.select(*made)


def merge_changes(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str],
                  order: list[Column]) -> DataFrame:
    """The result of ``merge_upsert`` with ``change``: inserted, changed, untouched or absent from the updates.

    ``untouched`` rows were updated with what they already held. One join gives table and changes.
    """
    marked = target.withColumn("_was", F.struct(*target.columns))
    fresh = latest_per_key(updates, keys, order).withColumn("_seen", F.lit(True)).withColumn(
        "_was", F.lit(None).cast(marked.schema["_was"].dataType))
    merged = merge_upsert(marked.withColumn("_seen", F.lit(None).cast("boolean")), fresh, keys,
                          {**rules, "_seen": "overwrite"}, order)
    same = F.col("_was").eqNullSafe(F.struct(*target.columns))
    return merged.withColumn("change", classify([
        ("absent", F.col("_seen").isNull()), ("inserted", F.col("_was").isNull()), ("untouched", same)],
        "changed")).drop("_was", "_seen")


def content_addressed_append(existing: DataFrame, rows: DataFrame, payload: list[str],
                             sha: str = "sha") -> DataFrame:
    """Give each row its content hash; ``created`` is false when the hash is already stored.

    Copies inside the batch collapse to one row before the shuffle.
    """
    hashed = rows.withColumn(sha, F.sha2(F.to_json(F.struct(*sorted(payload))), 256))
    unique = hashed.dropDuplicates([sha])
    known = existing.select(sha).distinct().withColumn("_known", F.lit(True))
    return unique.join(known, sha, "left").withColumn(
        "created", F.col("_known").isNull()).drop("_known")


def diff_snapshots(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """new / changed / unchanged / no_longer_listed per key."""
    a = old.select(*key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    return a.join(b, key, "full_outer").select(
        *key,
        classify([
            ("new", F.col("_in_a").isNull()),
            ("no_longer_listed", F.col("_in_b").isNull()),
            ("unchanged", F.col("_a").eqNullSafe(F.col("_b"))),
        ], "changed").alias("change"),
    )


def top_n_with_other(df: DataFrame, scope: list[str], label: str, size: str, n: int) -> DataFrame:
    """Largest ``n`` groups of each scope by size then label; the rest fold into one row.

    Input: one row per (scope, label). The tail is summed from the difference between the
    scope's totals and its top rows, so no scope is ever sorted in one task.
    """
    top = top_per_key(df, scope, [F.col(size).desc(), F.col(label)], n)
    totals = df.groupBy(*scope).agg(F.sum(size).alias("_all"), F.count(F.lit(1)).alias("_groups"))
    kept = top.groupBy(*scope).agg(F.sum(size).alias("_kept"), F.count(F.lit(1)).alias("_top"))
    rest = totals.join(kept, scope).filter(F.col("_groups") > F.col("_top")).select(
        *scope,
        F.concat(F.lit("Other "), (F.col("_groups") - F.col("_top")).cast("string"),
                 F.lit(" groups")).alias(label),
        (F.col("_all") - F.col("_kept")).alias(size),
        F.lit(True).alias("is_other"),
    )
    return top.select(*scope, label, size, F.lit(False).alias("is_other")).unionByName(rest)


def mode_with_ties(counts: DataFrame, scope: list[str], size: str) -> DataFrame:
    """Rows of ``counts`` whose size equals the scope's maximum (map-side limited by rank)."""
    w = Window.partitionBy(*scope).orderBy(F.col(size).desc())
    return counts.withColumn("_rk", F.rank().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def one_row(*frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Put single-row frames (one row per ``by`` value) side by side without a join."""
    keys = by or []
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in stacked.columns if c not in keys])
