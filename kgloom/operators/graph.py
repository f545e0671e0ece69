"""Filters, search, neighbourhoods, paths and components of a graph.

A graph is two DataFrames: nodes (id, label, type, size, ...) and directed edges (src, dst, weight, relationship_type,
...). Ties go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_filled
from .iterate import components, materialize, numbered, written


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def page(self, type: str | None = None, min_size: float | None = None, min_weight: float | None = None, limit: int = 50, offset: int = 0) -> tuple[Graph, DataFrame]:  # noqa: A002
        """One page of the filtered nodes, the filtered edges between known nodes, and the number of filtered nodes."""
        found = filter_nodes(self.nodes, type=type, min_size=min_size)
        edges = drop_dangling(filter_edges(self.edges, min_weight=min_weight), self.nodes)
        return Graph(page(found, [F.col("id")], limit, offset), edges), found.agg(F.count("*").alias("total"))


def filter_nodes(nodes: DataFrame, type: str | None = None, min_size: float | None = None, max_size: float | None = None, search: str | None = None) -> DataFrame:  # noqa: A002
    for c in (F.col("type") == type if type is not None else None, F.col("size") >= min_size if min_size is not None else None, F.col("size") <= max_size if max_size is not None else None, F.contains(F.lower("label"), F.lit(search.lower())) if search else None):
        nodes = nodes if c is None else nodes.where(c)
    return nodes


def filter_edges(edges: DataFrame, min_weight: float | None = None, max_weight: float | None = None, type: str | None = None) -> DataFrame:  # noqa: A002
    for c in (F.col("weight") >= min_weight if min_weight is not None else None, F.col("weight") <= max_weight if max_weight is not None else None, F.col("relationship_type") == type if type is not None else None):
        edges = edges if c is None else edges.where(c)
    return edges


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_of(params: dict) -> tuple[int, int]:
    """(limit, offset) of a request: limit 1 to 100, 50 if absent; offset by start or by page number."""
    def whole(*names: str) -> int | None:
        return next((int(params[n]) for n in names if str(params.get(n, "")).lstrip("-").isdigit()), None)

    limit = min(100, max(1, whole("limit", "per_page", "page_size") or 50))
    offset = whole("offset", "start")
    if offset is None:
        offset = (max(1, whole("page") or 1) - 1) * limit
    return limit, max(0, offset)


#: Request names of sort fields.
SORT_NAMES = {"created": "created_at", "updated": "updated_at", "name": "label"}


def sort_of(params: dict) -> tuple[str, bool] | None:
    """(column, descending) of a request's sort or sort_by; an unknown direction is ascending."""
    field, direction = params.get("sort_by") or params.get("order_by"), params.get("direction") or params.get("order") or "asc"
    if params.get("sort"):
        field, _, direction = str(params["sort"]).partition(":")
    if not field:
        return None
    return SORT_NAMES.get(field, field), str(direction).lower() == "desc"


#: Request names of node and edge filters.
FILTER_NAMES = {"node_type": "type", "nodeType": "type", "minSize": "min_size", "maxSize": "max_size", "minWeight": "min_weight", "maxWeight": "max_weight", "edgeType": "edge_type", "relationship_type": "edge_type"}


def apply_request(graph: Graph, params: dict) -> Graph:
    """A request's filters (given flat or under filter, filters or where), sort and page."""
    given: dict = {}
    for part in (params, *(params[k] for k in ("filter", "filters", "where") if isinstance(params.get(k), dict))):
        given |= {FILTER_NAMES.get(k, k): v for k, v in part.items()}
    nodes = filter_nodes(graph.nodes, given.get("type"), given.get("min_size"), given.get("max_size"), given.get("search"))
    edges = filter_edges(graph.edges, given.get("min_weight"), given.get("max_weight"), given.get("edge_type"))
    sort = sort_of(params)
    order = [F.col(sort[0]).desc() if sort[1] else F.col(sort[0]).asc()] if sort else []
    return Graph(page(nodes, [*order, F.col("id")], *page_of(params)), drop_dangling(edges, graph.nodes))


def node_by_id(nodes: DataFrame, id: str) -> DataFrame:  # noqa: A002
    return nodes.where(F.col("id") == id).limit(1)


def top_by(df: DataFrame, column: str, k: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.coalesce(F.col(column), F.lit(0)).desc(), tie).limit(k)


def search_nodes(nodes: DataFrame, query: str, type: str | None = None, limit: int = 20) -> DataFrame:  # noqa: A002
    """Nodes whose label contains the query in any case, largest first, with a constant score."""
    return top_by(filter_nodes(nodes, type=type, search=query), "size", limit).withColumn("score", F.lit(1.0))


def view_filter(graph: Graph, node_size: float, edge_weight: float, max_nodes: int, progressive: bool = True) -> Graph:
    """Nodes of at least node_size (10 where missing), the largest max_nodes of them (or the first by id), and edges of
    at least edge_weight (1 where missing) between those."""
    nodes = graph.nodes.where(F.coalesce("size", F.lit(10)) >= node_size)
    nodes = nodes.orderBy(*([F.coalesce("size", F.lit(10)).desc()] if progressive else []), "id").limit(max_nodes)
    return Graph(nodes, drop_dangling(graph.edges.where(F.coalesce("weight", F.lit(1)) >= edge_weight), nodes))


def endpoints(edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """(id, other): both ends of each edge; a self-loop counts twice, or once."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    return edges.select(F.explode(F.array_distinct(ends) if loops_once else ends).alias("e")).select("e.id", "e.other")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): each id's distinct neighbours in any direction, sorted."""
    return endpoints(edges).groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, level): ids within depth steps in any direction of the start ids, with their least distance. The edges are written
    once in both directions; each step keeps only ids that it reaches."""
    both = materialize(endpoints(edges)) if depth > 1 else endpoints(edges)
    seen = materialize(start.select("id").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        reached = both.join(front.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct()
        front = materialize(reached.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def subgraph(graph: Graph, id: str, depth: int = 1) -> Graph:  # noqa: A002
    """Nodes within depth steps and the distinct edges met on the way: those with an end closer than depth. The centre
    is always in; edges between two nodes at the rim are not."""
    start = graph.nodes.sparkSession.createDataFrame([(id,)], "id string")
    reach = materialize(k_hop(graph.edges, start, depth))
    inner = reach.where(F.col("level") < depth).select(F.col("id").alias("__i"))
    e = graph.edges
    edges = e.join(inner, e["src"] == F.col("__i"), "left_semi").unionByName(e.join(inner, e["dst"] == F.col("__i"), "left_semi")).distinct()
    return Graph(graph.nodes.join(reach, "id"), edges)


def neighbour_levels(edges: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """Direct and second neighbours of a node: (id, level)."""
    start = edges.sparkSession.createDataFrame([(id,)], "id string")
    return k_hop(edges, start, 2).where("level > 0")


def paths(edges: DataFrame, src: str, dst: str | None = None, max_length: int = 5) -> DataFrame:
    """All paths in any direction of 1 to max_length edges from src (to dst), no edge used twice: vertices, types,
    length (edges) and total weight. Parallel edges are edges of their own, also equal ones."""
    numbered = materialize(edges.select("src", "dst", "weight", "relationship_type")).withColumn("eid", F.monotonically_increasing_id())
    ends = F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))
    step = materialize(numbered.withColumn("e", F.explode(F.array_distinct(ends))).select("e.at", "e.to", "weight", "relationship_type", "eid"))
    front = edges.sparkSession.createDataFrame([(src,)], "at string").select("at", F.array("at").alias("vertices"), F.array().cast("array<string>").alias("types"), F.array().cast("array<bigint>").alias("used"), F.lit(0.0).alias("total_weight"))
    out = None
    for n in range(1, max_length + 1):
        front = front.join(step, "at").where(~F.array_contains("used", F.col("eid")))
        front = materialize(front.select(F.col("to").alias("at"), F.concat("vertices", F.array("to")).alias("vertices"), F.concat("types", F.array("relationship_type")).alias("types"), F.concat("used", F.array("eid")).alias("used"), (F.col("total_weight") + F.coalesce("weight", F.lit(1))).alias("total_weight")))
        done = front.select("at", "vertices", "types", F.lit(n).alias("length"), "total_weight")
        out = done if out is None else out.unionByName(done)
    return out if dst is None else out.where(F.col("at") == dst)


def shortest_path(edges: DataFrame, src: str, dst: str | Column, max_length: int = 5) -> DataFrame:
    """The first of the paths that paths() lists by length, total weight and vertices, to a vertex or to any that meets a
    condition on `at`; none within max_length: no row. A vertex keeps only the best path of the step that reaches it first,
    and the search ends at the first step that reaches a target, so rows are vertices, not walks."""
    goal = F.col("at") == dst if isinstance(dst, str) else dst
    e = edges.select("src", "dst", "weight", "relationship_type")
    both = F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))
    front = edges.sparkSession.createDataFrame([(src,)], "at string").select("at", F.array("at").alias("vertices"), F.array().cast("array<string>").alias("types"), F.lit(0).alias("length"), F.lit(0.0).alias("total_weight"))
    seen = front.select("at")
    for n in range(1, max_length + 1):
        step = e.select(F.explode(both).alias("e"), "weight", "relationship_type").select("e.at", "e.to", "weight", "relationship_type")
        more = front.join(step, "at").join(seen.select(F.col("at").alias("to")), "to", "left_anti")
        path = F.struct((F.col("total_weight") + F.coalesce("weight", F.lit(1))).alias("total_weight"), F.concat("vertices", F.array("to")).alias("vertices"), F.concat("types", F.array("relationship_type")).alias("types"))
        best = more.select("to", path.alias("p")).groupBy("to").agg(F.min("p").alias("p"))
        front = materialize(best.select(F.col("to").alias("at"), "p.vertices", "p.types", F.lit(n).alias("length"), "p.total_weight"))
        seen = seen.unionByName(front.select("at"))
        found = front.where(goal)
        if not found.isEmpty() or front.isEmpty():
            return found.orderBy("total_weight", "vertices").limit(1)
    return front.limit(0)


def connected(graph: Graph) -> DataFrame:
    """(id, component) over the edges between known nodes; a component is named by its least id. Rounds run on the nodes' numbers in
    the order of ids, which edges get by joins that leave out those of unknown nodes."""
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")).distinct(), ["name"], "id").select("id", "name"))
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    e = graph.edges.where("src <> dst").select("src", "dst").join(by("src", "a"), "src").join(by("dst", "b"), "dst")
    found = components(names.select("id"), e.select("a", "b"), keep=written)
    called = names.select(F.col("id").alias("component"), F.col("name").alias("least"))
    return names.join(found, "id").join(called, "component").select(F.col("name").alias("id"), F.col("least").alias("component"))


def communities(graph: Graph) -> DataFrame:
    """Components of two nodes or more: community number (by least id), its size, and its nodes."""
    c = materialize(connected(graph))
    groups = c.groupBy("component").agg(F.count("*").alias("community_size")).where("community_size > 1")
    ranked = numbered(groups, ["component"], "community")
    return c.join(ranked, "component").select("community", "community_size", "id")


def named_clusters(graph: Graph) -> DataFrame:
    """Components named by their largest node, as '<label> Group' and 'n connected concepts'."""
    c = graph.nodes.join(connected(graph), "id")
    largest = F.min_by("label", F.struct((-F.coalesce("size", F.lit(0.0))).alias("s"), "id"))
    g = c.groupBy("component").agg(largest.alias("label"), F.count("*").alias("n_nodes"))
    return g.select("component", F.concat("label", F.lit(" Group")).alias("name"), "n_nodes", F.concat(F.col("n_nodes").cast("string"), F.lit(" connected concepts")).alias("description"))


def resolve_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters: (cluster, label) as a model named them. Members by label in any case; empty clusters drop out; nodes in
    none go to misc_cluster."""
    wanted = clusters.select("cluster", F.lower(F.trim("label")).alias("__k")).distinct()
    found = nodes.select("id", F.lower(F.trim("label")).alias("__k")).join(wanted, "__k").select("cluster", "id").distinct()
    rest = nodes.select("id").join(found, "id", "left_anti").select(F.lit("misc_cluster").alias("cluster"), "id")
    return found.unionByName(rest)


def closeness(graph: Graph, sources: DataFrame | None = None, max_hops: int = 5, far: int = 999) -> DataFrame:
    """Closeness of each source over edges followed forwards: 1 over the mean distance to all other nodes, `far` where
    there is no path of max_hops; 0 where the mean is `far`. Grows with sources times reach: pass sources to bound it."""
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")).distinct(), ["name"], "id").select("id", "name"))
    n = names.count()
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    e = graph.edges.where("src <> dst").select("src", "dst").distinct()
    step = written(e.join(by("src", "a"), "src").join(by("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    start = names if sources is None else names.join(sources.select(F.col("id").alias("name")).distinct(), "name", "left_semi")
    seen = written(start.select(F.col("id").alias("s"), "id", F.lit(0).alias("d")))
    front = seen
    for d in range(1, max_hops + 1):
        reached = front.join(step, front["id"] == step["src"]).select("s", F.col("dst").alias("id")).distinct()
        front = written(reached.join(seen, ["s", "id"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    per = seen.groupBy(F.col("s").alias("id")).agg(F.sum("d").alias("near"), (F.count("*") - 1).alias("reached"))
    mean = (F.col("near") + (F.lit(n - 1) - F.col("reached")) * far) / F.lit(n - 1) if n > 1 else F.lit(float(far))
    per = per.join(names, "id").select(F.col("name").alias("id"), "near", "reached")
    return per.select("id", "reached", mean.alias("avg_distance")).withColumn("closeness", F.when(F.col("avg_distance") < far, 1 / F.col("avg_distance")).otherwise(0.0))


#: Neighbours in one list.
CHUNK = 1024


def label_propagation(graph: Graph, rounds: int = 5) -> DataFrame:
    """(id, label): each round every node takes the commonest label of its neighbours, the least of equally common ones.

    Nodes go by their number in the order of ids. Neighbours are kept in lists of about CHUNK, so a round sends a list instead of a row
    for each link, and counts are added up before they are shuffled. In the first round all labels differ, so the least neighbour is
    taken at once."""
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")).distinct(), ["name"], "id").select("id", "name"))
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    now = names.select("id", F.col("id").alias("label"))
    if rounds:
        e = graph.edges.select("src", "dst").join(by("src", "a"), "src").join(by("dst", "b"), "dst")
        pairs = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turned = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
        ends = pairs.unionByName(turned)
        least = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("new"), F.ceil(F.count("*") / CHUNK).alias("cuts"))
        least = written(now.join(least, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "cuts"))
        now = least.select("id", "label")
    if rounds > 1:
        # a list belongs to the node that tells its label, and names those that hear it
        cut = ends.join(least.where("cuts > 1").select(F.col("id").alias("a"), "cuts"), "a", "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("b"), "cuts"), F.lit(0).cast("long")))
        near = written(cut.groupBy("a", "cut").agg(F.array_sort(F.collect_list("b")).alias("at")).select("a", "at"))
    for _ in range(rounds - 1):
        told = near.join(now.withColumnRenamed("id", "a"), "a").select(F.explode("at").alias("id"), "label")
        seen = told.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = seen.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        now = written(now.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    named = names.select(F.col("id").alias("label"), F.col("name").alias("__label"))
    return now.join(names, "id").join(named, "label").select(F.col("name").alias("id"), F.col("__label").alias("label"))


def graph_to_text(graph: Graph) -> DataFrame:
    """One line per edge between known nodes and one per node."""
    a, b = graph.nodes.select(F.col("id").alias("src"), F.col("label").alias("a")), graph.nodes.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    lines = graph.edges.join(a, "src").join(b, "dst").select(F.format_string("%s -> %s (%s)", "a", "b", first_filled("relationship_type", F.lit("related"))).alias("line"))
    return graph.nodes.select(F.format_string("%s (%s)", "label", first_filled("type", F.lit("concept"))).alias("line")).unionByName(lines)


def sample_graph(spark: SparkSession) -> Graph:
    """A small graph of three nodes and two edges, for trials; it never replaces a failed result."""
    nodes = spark.createDataFrame([("n1", "Photosynthesis", "process", 30.0), ("n2", "Chlorophyll", "material", 25.0), ("n3", "Light", "condition", 20.0)], "id string, label string, type string, size double")
    return Graph(nodes, spark.createDataFrame([("n1", "n2", 3.0, "DEPENDS_ON"), ("n1", "n3", 2.0, "DEPENDS_ON")], "src string, dst string, weight double, relationship_type string"))
