"""Anomalies by an isolation forest: random trees on bounded seeded samples, which each distinct row goes down once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph, drop_dangling
from .iterate import written


def mean_path(n: float) -> float:
    """Mean depth at which a search fails in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Tree:
    """A complete binary tree in arrays: node i has the children 2i + 1 and 2i + 2. feature is -1 at a leaf, whose length is its
    depth and the mean path of the rows left there."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, depth: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.feature, self.split, self.length = np.full(n, -1), np.zeros(n), np.zeros(n)
        todo = [(0, 0, np.arange(len(x)))]
        while todo:
            i, d, rows = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            usable = np.flatnonzero(high > low)
            if d == depth or len(rows) <= 1 or not len(usable):
                self.length[i] = d + mean_path(len(rows))
                continue
            f = int(rng.choice(usable))
            s = float(rng.uniform(low[f], high[f]))
            s = s if s > low[f] else float(high[f])  # so that neither side is empty
            self.feature[i], self.split[i] = f, s
            left = x[rows, f] < s
            todo += [(2 * i + 1, d + 1, rows[left]), (2 * i + 2, d + 1, rows[~left])]


def isolation_forest(features: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> list[Tree]:
    """Trees fitted on `sample` rows each, dealt from the trees * sample rows of least hash of id (25,600 by default, the bound of what the
    driver gets); of smaller tables each tree draws its rows from all."""
    pool = features.select("id", *columns).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(trees * sample).toPandas()
    x, rng = pool[columns].to_numpy(np.float64), np.random.default_rng(seed)
    if not len(x):
        return []
    dealt = len(x) == trees * sample
    rows = lambda t: x[t::trees] if dealt else x[rng.choice(len(x), min(sample, len(x)), replace=False)]
    depth = math.ceil(math.log2(max(2, min(sample, len(x)))))
    return [Tree(rows(t), rng, depth) for t in range(trees)]


def isolation_scores(features: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """features (id and numeric columns) with `score`, from 0 to 1: the sooner random cuts part a row from others, the nearer to 1; about
    0.5 and less is ordinary. Missing values are 0. Equal ids may repeat; reruns agree. Rows equal in all columns have equal
    scores; empty table: no rows."""
    clean = written(features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}))
    forest = isolation_forest(clean, columns, trees, sample, seed)
    if not forest:
        return clean.withColumn("score", F.lit(0.0))
    # each distinct row goes down the trees once
    kinds = clean.select(*columns).distinct().withColumn("__total", _lengths(forest)(F.array(*columns)))
    size = min(sample, clean.limit(sample).count())
    score = F.pow(F.lit(2.0), -F.col("__total") / len(forest) / max(mean_path(size), 1e-9))
    return clean.join(kinds, columns).withColumn("score", score).select(*features.columns, "score")


def _lengths(forest: list[Tree]) -> Callable[[Column], Column]:
    """The sum of the path lengths of rows (arrays of numbers) in all trees; a missing number lies above all others, as in Spark."""
    depth = int(math.log2(len(forest[0].feature) + 1)) - 1

    def run(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        each, total = np.arange(len(x)), np.zeros(len(x))
        for t in forest:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = t.feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + ~(x[each, f] < t.split[at]))
            total += t.length[at]
        return pa.array(total)

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}  # as types, not as text
    return F.arrow_udf(run, "double")


def degree_features(graph: Graph) -> DataFrame:
    """(id, edges_in, edges_out, weight_in, weight_out, kinds) of every node: edges and their weights by direction, and the number of
    relationship types at it. Edges to unknown nodes don't count."""
    e = drop_dangling(graph.edges, graph.nodes).withColumn("w", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    end = lambda c, out: e.select(F.col(c).alias("id"), F.lit(out).alias("out"), "w", "relationship_type")
    both = end("src", True).unionByName(end("dst", False))
    # by type first, so that types are counted without a row for each edge and count
    each = both.groupBy("id", "relationship_type").agg(F.count_if(~F.col("out")).alias("edges_in"), F.count_if("out").alias("edges_out"), F.sum(F.when(~F.col("out"), F.col("w")).otherwise(0.0)).alias("weight_in"), F.sum(F.when(F.col("out"), F.col("w")).otherwise(0.0)).alias("weight_out"))
    sums = each.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("edges_in", "edges_out", "weight_in", "weight_out")], F.count("relationship_type").alias("kinds"))
    return graph.nodes.select("id").distinct().join(sums, "id", "left").fillna(0)


def anomalies(graph: Graph, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score) of every node by its degree features, see isolation_scores."""
    f = degree_features(graph)
    return isolation_scores(f, [c for c in f.columns if c != "id"], trees, sample, seed).select("id", "score")
