"""Helpers of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that lost executors never force a whole recomputation.

    The folder is the session's spark.checkpoint.dir; where that is unset, a temporary one is set in local mode (tests on one
    machine) and on a cluster, whose machines don't share one, it is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As materialize, but as Parquet files in that folder, read again. A checkpoint keeps the size that was estimated for its plan,
    which multiplies with each join: after some ten rounds of joins with itself planning alone takes minutes. Files have their true
    size, so small sides are also broadcast."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's folder that all machines share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kgloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """(id, component): the smallest id reachable from each id of nodes over the undirected edges (a, b).

    Alternates large-star and small-star rounds (both are a min per key, which Spark combines before its shuffle)
    until the edges form stars. Nodes must be distinct; ids on an edge must be in nodes. Self-loops and repeated
    edges are harmless; no edges: every node is its own component. Rounds grow with the logarithm of the longest path;
    edges that are no stars after max_rounds are an error. `keep` is what stores a round's edges: materialize or written.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, goes to the least of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = keep(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components were not found in {max_rounds} rounds")
    star = e.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(star, nodes["id"] == star["u"], "left").select("id", F.coalesce("m", "id").alias("component"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of each row in an order, from 0: rows are sorted in ranges, counted by range and numbered from where
    their range begins, so no task sees them all. Order by something unique for a definite result."""
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # place within the partition
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), inner.alias("__place")))
    begin, bases = 0, []
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row a partition
        bases.append((r["__range"], begin))
        begin += r["n"]
    base = df.sparkSession.createDataFrame(bases, "__range int, __base long")
    return ranged.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__place")).drop("__range", "__place", "__base")


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row (nulls if it has none), as a scalar subquery: no join is planned."""
    one = row.select(F.struct(*[F.col(c) for c in row.columns]).alias("one")).scalar()
    return df.withColumn("__one", one).select("*", "__one.*").drop("__one")
