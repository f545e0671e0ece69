"""Graph and paper views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


TEXTS = frozenset({"documents", "pages"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts in fewer file splits than there are cores (one small file) are dealt out, else a single core would do
    all the work on them; inputs of many splits are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and 4 * df.rdd.getNumPartitions() <= cores else df


def key(prefix: str, c: str):  # noqa: ANN201
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    size = lambda c: (10 + F.col(c) % 40).cast("double").alias("size")
    parts = [
        t("part").select(key("part_", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size")),
        t("supplier").select(key("supplier_", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("type"), size("s_suppkey")),
        t("customer").select(key("customer_", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("type"), size("c_custkey")),
        t("nation").select(key("nation_", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"), F.lit(30.0).alias("size")),
        t("region").select(key("region_", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("region").alias("type"), F.lit(40.0).alias("size")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supply_edges(spark: SparkSession, sf_dir: str, min_weight: int = 1) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    e = e if min_weight <= 1 else e.where(F.col("weight") >= min_weight)
    return e.select(key("supplier_", "l_suppkey").alias("src"), key("part_", "l_partkey").alias("dst"), "weight", F.lit("SUPPLIES").alias("relationship_type"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit(1.0).alias("weight"), F.lit("PART_OF").alias("relationship_type"))
    return (
        rows(t("supplier"), key("supplier_", "s_suppkey"), key("nation_", "s_nationkey"))
        .unionByName(rows(t("customer"), key("customer_", "c_custkey"), key("nation_", "c_nationkey")))
        .unionByName(rows(t("nation"), key("nation_", "n_nationkey"), key("region_", "n_regionkey")))
    )


def graph(spark: SparkSession, sf_dir: str, min_weight: int = 1, places: bool = True) -> Graph:
    e = supply_edges(spark, sf_dir, min_weight)
    return Graph(nodes(spark, sf_dir), e.unionByName(place_edges(spark, sf_dir)) if places else e)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of all edges, a supply link once for each of its lines: where weights don't count nothing is grouped."""
    t = table(spark, sf_dir, "lineitem").select(key("supplier_", "l_suppkey").alias("src"), key("part_", "l_partkey").alias("dst"))
    return t.unionByName(place_edges(spark, sf_dir).select("src", "dst"))


def geo_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir).where("type in ('supplier', 'customer', 'nation', 'region')"), place_edges(spark, sf_dir))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line is the title, the rest the abstract, the year comes from the id."""
    d = table(spark, sf_dir, "documents")
    line = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("paper_ix"), line.alias("title"), F.substr("text", F.char_length(line) + 2).alias("abstract"), F.col("lang").alias("keywords"), F.col("source").alias("journal"), (1995 + F.col("doc_id") % 31).cast("int").alias("pub_year"))
