"""Normalisation to the stored form, validation with quarantine, merging and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, edge_weight, filled, first_filled, node_size, node_type, nonzero, number, relationship_type, slug, store_key
from ..functions.dictionaries import NODE_TYPES, RELATIONSHIP_TYPES
from .graph import Graph
from .iterate import with_row


def stored_nodes(nodes: DataFrame) -> DataFrame:
    """Key, label, size, type of client nodes (id, label, size, type, pos); pos numbers those without id or label."""
    pos = F.col("pos").cast("string") if "pos" in nodes.columns else F.lit("0")
    return nodes.select(F.coalesce(store_key("id"), F.concat(F.lit("node_"), pos)).alias("key"), first_filled("label", F.concat(F.lit("Node "), pos)).alias("label"), node_size("size").alias("size"), node_type("type").alias("type"))


def stored_edges(edges: DataFrame) -> DataFrame:
    confidence = nonzero("confidence", 0.5) if "confidence" in edges.columns else F.lit(0.5)
    ref = lambda c: F.concat(F.lit("nodes/"), store_key(c))
    return edges.select(ref("src").alias("from"), ref("dst").alias("to"), edge_weight("weight").alias("weight"), relationship_type("relationship_type").alias("relationship_type"), confidence.alias("confidence"))


def client_nodes(stored: DataFrame) -> DataFrame:
    return stored.select(F.col("key").alias("id"), *[c for c in stored.columns if c != "key"])


def client_edges(stored: DataFrame) -> DataFrame:
    bare = lambda c: F.regexp_replace(c, "^nodes/", "")
    return stored.select(bare("from").alias("src"), bare("to").alias("dst"), *[c for c in stored.columns if c not in ("from", "to")])


def coerced_attributes(df: DataFrame) -> DataFrame:
    """Numeric attributes as numbers: whole citations, decimal importance, confidence within 0 and 1, distance at least 0."""
    rules = {"total_citations": lambda c: F.coalesce(F.floor(number(c)).cast("long"), F.lit(0)), "importance_score": lambda c: F.coalesce(number(c), F.lit(0.0)), "bert_confidence": lambda c: clamp(F.coalesce(number(c), F.lit(0.0)), 0.0, 1.0), "distance": lambda c: F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0)), "context_sentence": lambda c: F.substring(F.col(c).cast("string"), 1, 500)}
    return df.withColumns({c: f(c) for c, f in rules.items() if c in df.columns})


def _checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors: the names of the rules a row breaks. A null test counts as kept."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])))


def validate_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with errors). Empty strings count as missing."""
    c = _checked(nodes, {"label_required": filled("label").isNotNull(), "label_length": F.char_length("label") <= 200, "size_range": F.col("size").between(1, 100), "type_known": F.col("type").isin(NODE_TYPES)})
    return c.where(F.size("errors") == 0).drop("errors"), c.where(F.size("errors") > 0)


def validate_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = {"from_required": filled("src").isNotNull(), "to_required": filled("dst").isNotNull(), "weight_range": F.col("weight").between(0.1, 10), "type_known": F.col("relationship_type").isin(RELATIONSHIP_TYPES)}
    if "confidence" in edges.columns:
        rules["confidence_range"] = F.col("confidence").between(0, 1)
    c = _checked(edges, rules)
    return c.where(F.size("errors") == 0).drop("errors"), c.where(F.size("errors") > 0)


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Graphs laid together (rows carry pos): nodes by id or slug of their label keep the greatest size and distinct
    descriptions line by line; edges by source, target and label sum their weights."""
    n = nodes.withColumn("id", first_filled("id", slug("label")))
    desc = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(filled("description").isNotNull(), F.struct("pos", "description")))), lambda x: x["description"]))
    n = n.groupBy("id").agg(F.min_by("label", "pos").alias("label"), F.max("size").alias("size"), F.min_by("type", "pos").alias("type"), F.array_join(desc, "\n").alias("description"))
    e = edges.withColumn("label", first_filled("label", F.lit("related"))).groupBy("src", "dst", "label").agg(F.sum(nonzero("weight", 1)).alias("weight"))
    return Graph(n, e)


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair: the record of highest confidence, the greatest weight, all citations."""
    g = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    best = F.max_by(F.struct("src", "dst", "relationship_type", "confidence"), F.struct("confidence", "relationship_type", "src"))
    cites = F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))) if "citations" in edges.columns else F.array().cast("array<string>")
    return g.agg(best.alias("x"), F.max("weight").alias("weight"), cites.alias("citations")).select("x.*", "weight", "citations")


def rescale(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The column stretched to low..high and rounded half up; a single value becomes low."""
    s = df.agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    span = F.when(F.col("__b") > F.col("__a"), F.col("__b") - F.col("__a")).otherwise(1.0)
    return with_row(df, s).withColumn(column, F.floor(low + (F.col(column) - F.col("__a")) / span * (high - low) + 0.5)).drop("__a", "__b")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first (by pos) of each unordered pair, without self-loops."""
    w = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("pos")
    return edges.where("src <> dst").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
