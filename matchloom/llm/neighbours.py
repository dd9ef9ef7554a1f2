"""Approximate nearest neighbours with a hierarchical k-means tree (operator 6).

The tree is fitted on a bounded sample (``SAMPLE`` rows, chosen by hash): the largest node is
split by k-means until there are enough leaves. Every row is filed in the leaf it descends to. A query walks the tree
best bin first: a priority queue of nodes by distance to their centre gives the leaves in order. How
many leaves a query visits is calibrated: for ``CALIBRATION`` of the queries the true neighbours are
found by comparison with all rows, and visits are widened until the wanted share of them is reached. A walk
goes on past that count until the leaves it has met hold k rows besides the query's own.

A query meets its leaves in two steps. The first, as many as the root of its visits, give k rows whose
farthest bounds the others: from a later leaf only rows within that distance leave their task. Leaves
are compared block by block: a leaf's rows and the queries that visit it are dealt to blocks of at
most ``ROWS`` and ``QUERIES`` rows by hash, so a leaf that holds a third of all vectors is many tasks,
and each task keeps the best k of each query only. The tree has at most ``MOST_LEAVES`` leaves; it and
the table of leaf sizes are broadcast.

Defined cases. Vectors that are null, zero, or hold a null or non-finite component take no part,
neither do rows without an id, nor vectors whose length is not the most frequent one (the longer one of two
equally frequent). Repeated rows are candidates of each other. Ties go to the smaller id. With
fewer candidates than k all are returned; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize

SAMPLE = 20_000
BRANCH = 8
LEAF_ROWS = 128
MOST_LEAVES = 2048
ROWS, QUERIES = 4096, 1024
CALIBRATION = 200
RECALL = 0.97
SEED = 6


def means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means with distance-weighted starts; returns the label of each point."""
    centres = [points[rng.integers(len(points))]]
    gap = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and gap.sum() > 0:
        centres.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(rounds):
        labels = nearest(points, centres)
        centres = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else centres[c]
                            for c in range(len(centres))])
    return nearest(points, centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


class Tree:
    """Nodes with the centres of their children; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        rng = np.random.default_rng(SEED)
        self.children: list[list[int]] = [[]]
        self.centres: list[np.ndarray | None] = [None]
        queue = [(-len(sample), 0, np.arange(len(sample)))]
        open_leaves = 1
        while queue and open_leaves < leaves:
            _, node, members = heapq.heappop(queue)
            if len(members) < 2 * BRANCH:
                continue
            labels = means(sample[members], BRANCH, rng)
            groups = [members[labels == c] for c in np.unique(labels)]
            if len(groups) < 2:
                continue
            self.centres[node] = np.array([sample[g].mean(axis=0) for g in groups])
            for g in groups:
                self.children[node].append(len(self.children))
                heapq.heappush(queue, (-len(g), len(self.children), g))
                self.children.append([])
                self.centres.append(None)
            open_leaves += len(groups) - 1

    def file(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        at = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node] or not len(rows):
                at[rows] = node
                continue
            pick = nearest(points[rows], self.centres[node])
            todo += [(child, rows[pick == c]) for c, child in enumerate(self.children[node])]
        return at

    def walk(self, point: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
                continue
            for gap, child in zip(((self.centres[node] - point) ** 2).sum(axis=1), self.children[node]):
                heapq.heappush(queue, (float(gap), child))


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector, _row) of the rows that take part, with vectors in double precision."""
    got = rows.select(rows[id_column].cast("long").alias("vec_id"),
                      rows[vector_column].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = got.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(
        fine & F.exists("vector", lambda x: x != 0))
    got = materialize(got.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    width = got.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return got.filter(F.size("vector") == (width["w"] if width else 0))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = points - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def best_of(query_row: int, query_id: int, query: np.ndarray, rows: np.ndarray, ids: np.ndarray,
            points: np.ndarray, k: int, bound: float = np.inf) -> tuple:
    """The k nearest of a block within ``bound``, ties to the smaller id, without the query's own row."""
    gap = np.where(rows == query_row, np.inf, distances(points, query))
    if len(gap) > 4 * k:  # all ties of the k-th stay in
        bound = min(bound, np.partition(gap, k - 1)[k - 1])
    chosen = np.flatnonzero((gap <= bound) & np.isfinite(gap))
    order = chosen[np.lexsort((rows[chosen], ids[chosen], gap[chosen]))][:k]
    return np.full(len(order), query_row), np.full(len(order), query_id), ids[order], rows[order], gap[order]


def gathered(parts: list[tuple]) -> pd.DataFrame:
    names = ["_query", "query_id", "vec_id", "_row", "score"]
    if not parts:
        return pd.DataFrame({n: [] for n in names})
    return pd.DataFrame({n: np.concatenate(column) for n, column in zip(names, zip(*parts))})


FOUND = "_query long, query_id long, vec_id long, _row long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_query").orderBy("score", "vec_id", "_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """True neighbours of a bounded set of queries: each task compares its rows with all of them."""
    asked = queries.select("_row", "vec_id", "vector").collect()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points, own, ids = matrix(batch["vector"]), batch["_row"].to_numpy(), batch["vec_id"].to_numpy()
            yield gathered([best_of(q["_row"], q["vec_id"], np.array(q["vector"]), own, ids, points, k)
                            for q in asked])

    return ranked(rows.mapInPandas(compare, FOUND), k)


def calibrate(tree: Tree, queries: DataFrame, filed: DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours of a query sample are met."""
    some = materialize(queries.orderBy(F.xxhash64(F.lit(SEED), "_row"), "_row").limit(CALIBRATION), "asked")
    true = exact(some, filed, k).join(filed.select("_row", "leaf"), "_row").select("_query", "leaf").collect()
    points = {r["_row"]: np.array(r["vector"]) for r in some.select("_row", "vector").collect()}
    place = {q: {leaf: n for n, leaf in enumerate(tree.walk(p), 1)} for q, p in points.items()}
    needed = sorted(place[r["_query"]][r["leaf"]] for r in true)
    if not needed:
        return 1
    return int(needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1])


def compared(filed: DataFrame, asked: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The best k rows of every block for each (query, leaf) of ``asked``, none beyond the query's ``bound``."""
    visited = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("query_blocks"))
    plan = materialize(sizes.join(visited, "leaf"), "leaves")  # a row per leaf

    def dealt(left: DataFrame, own: str, other: str) -> DataFrame:
        blocks = left.join(F.broadcast(plan), "leaf").withColumn(
            own, F.pmod(F.xxhash64("_row"), F.col(own + "s")))
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))).drop(
            "row_blocks", "query_blocks")

    def compare(candidates: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(some):
            return gathered([])
        points, own = matrix(candidates["vector"]), candidates["_row"].to_numpy()
        ids = candidates["vec_id"].to_numpy()
        return gathered([best_of(r, i, q, own, ids, points, k, b) for r, i, q, b in zip(
            some["_row"], some["vec_id"], matrix(some["vector"]), some["bound"])])

    keys = ["leaf", "row_block", "query_block"]
    there = dealt(filed, "row_block", "query_block").groupBy(*keys)
    here = dealt(asked, "query_block", "row_block").groupBy(*keys)
    return ranked(there.cogroup(here).applyInPandas(compare, FOUND), k)


def search(rows: DataFrame, is_query, k: int = 10, recall: float = RECALL, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query row.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = rows.sparkSession
    valid = usable(rows, id_column, vector_column)
    n = valid.count()
    sample = matrix(valid.orderBy(F.xxhash64(F.lit(SEED), "_row"), "_row").limit(SAMPLE)
                    .select("vector").toPandas()["vector"])
    leaves = max(1, min(n // LEAF_ROWS, len(sample) // BRANCH, MOST_LEAVES))
    tree = Tree(sample if len(sample) else np.zeros((0, 1)), leaves)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=shared.value.file(matrix(batch["vector"])))

    filed = materialize(valid.mapInPandas(
        file, "vec_id long, vector array<double>, _row long, leaf long"), "filed")
    queries = filed.filter(is_query).select("_row", "vec_id", "vector")
    visits = calibrate(tree, queries, filed, k, recall)

    held = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves = []
            for point in matrix(batch["vector"]):
                met, seen = [], 0
                for leaf in shared.value.walk(point):
                    if len(met) >= visits and seen > k:  # the query's own row is in one of them
                        break
                    met.append(leaf)
                    seen += held.get(leaf, 0)
                leaves.append(met)
            yield batch.assign(leaves=leaves)

    asked = materialize(queries.mapInPandas(
        ask, "_row long, vec_id long, vector array<double>, leaves array<long>"), "asked")
    sizes = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("row_blocks"))
    first = int(np.ceil(np.sqrt(visits)))
    near = asked.withColumn("leaf", F.explode(F.slice("leaves", 1, first))).withColumn(
        "bound", F.lit(float("inf"))).drop("leaves")
    found = materialize(compared(filed, near, sizes, k), "near")
    bounds = found.filter(F.col("rank") == k).select(F.col("_query").alias("_row"), F.col("score").alias("bound"))
    far = asked.withColumn("leaf", F.explode(F.slice("leaves", F.lit(first + 1), F.size("leaves")))).drop("leaves")
    far = far.join(bounds, "_row", "left").fillna({"bound": float("inf")})
    both = found.unionByName(compared(filed, far, sizes, k)).drop("rank")
    return ranked(both, k).select("query_id", "rank", "vec_id", "score")
