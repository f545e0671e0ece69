"""Structure, centrality, modularity and gap measures of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import jaccard, tokens
from .graph import Graph, adjacency, connected, drop_dangling, endpoints, top_by
from .iterate import materialize, numbered, with_row, written


def structure(graph: Graph) -> DataFrame:
    """One row: nodes, edges, average degree 2E/N and density 2E/(N(N-1)), 0 where undefined."""
    n, e = graph.nodes.agg(F.count("*").alias("n_nodes")), graph.edges.agg(F.count("*").alias("n_edges"))
    both = with_row(n, e)
    nodes, edges = F.col("n_nodes"), F.col("n_edges")
    return both.select("n_nodes", "n_edges", F.coalesce(F.try_divide(2.0 * edges, nodes), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.try_divide(2.0 * edges, nodes * (nodes - 1)), F.lit(0.0)).alias("density"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every node over incident edges; a self-loop counts once, parallel edges each, isolated nodes 0."""
    d = endpoints(graph.edges, loops_once=True).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_distribution(graph: Graph) -> DataFrame:
    """(degree, n, probability)."""
    d = degrees(graph).groupBy("degree").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    return with_row(d, total).select("degree", "n", (F.col("n") / F.col("total")).alias("probability"))


def connectivity(graph: Graph) -> DataFrame:
    """One row: number of isolated nodes, least, greatest and mean degree."""
    return degrees(graph).agg(F.count_if(F.col("degree") == 0).alias("isolated"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))


def isolated_nodes(graph: Graph, k: int = 10) -> DataFrame:
    return degrees(graph).where("degree = 0").orderBy("id").limit(k)


def hubs(graph: Graph, share: float = 0.1) -> DataFrame:
    """The ceil(share N) nodes of highest degree. The cut is found from the degree histogram; the nodes of the last degree are
    numbered by id in ranges."""
    d = materialize(degrees(graph))
    total = d.count()
    want = -(-total * int(round(share * 1000)) // 1000)
    above, cut = 0, None
    for r in d.groupBy("degree").count().orderBy(F.desc("degree")).toLocalIterator():
        if above + r["count"] >= want:
            cut = r["degree"]
            break
        above += r["count"]
    if cut is None:
        return d.limit(0)
    return d.where(F.col("degree") > cut).unionByName(numbered(d.where(F.col("degree") == cut), ["id"], "__place").where(F.col("__place") < want - above).drop("__place"))


def degree_centrality(graph: Graph) -> DataFrame:
    """In-, out- and total degree of every node; a self-loop counts in both."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0)
    return graph.nodes.join(d, "id", "left").select("id", "label", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"), (F.coalesce("in_degree", zero) + F.coalesce("out_degree", zero)).alias("degree"))


def betweenness_estimate(graph: Graph) -> DataFrame:
    """The square of the degree stands for betweenness."""
    return degrees(graph).select("id", "label", (F.col("degree") * F.col("degree")).alias("betweenness"))


def centrality(graph: Graph, metrics: tuple[str, ...] = ("degree", "betweenness")) -> dict[str, DataFrame]:
    from .graph import closeness

    known = {"degree": degree_centrality, "betweenness": betweenness_estimate, "closeness": closeness}
    return {m: known[m](graph) for m in metrics if m in known}


def network_metrics(graph: Graph) -> DataFrame:
    """One row over ids with an edge end, whether nodes or not: a self-loop counts twice; rounded to 2 and 4 places."""
    d = endpoints(graph.edges).groupBy("id").agg(F.count("*").alias("degree")).agg(F.avg("degree").alias("a"), F.max("degree").alias("m"))
    s = with_row(structure(graph), d)
    return s.select("n_nodes", "n_edges", F.round(F.coalesce("a", F.lit(0.0)), 2).alias("avg_degree"), F.coalesce("m", F.lit(0)).alias("max_degree"), F.round("density", 4).alias("density"), (F.col("n_edges") > 0).alias("connected"))


def top_nodes(graph: Graph, k: int = 10) -> DataFrame:
    """Nodes of highest degree over edge ends."""
    d = endpoints(graph.edges).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.join(d, "id").select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(k)


def recommendations_by_degree(graph: Graph, k: int = 5) -> DataFrame:
    return top_nodes(graph, k).select("id", F.format_string("Consider '%s' (%d connections) as a key concept", "label", "degree").alias("text"), F.lit("high").alias("priority"))


def by_type(nodes: DataFrame) -> DataFrame:
    """(type, n, ids): lists grow with a type; use type_counts where only numbers are needed."""
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def internal_edges(graph: Graph, member: DataFrame) -> DataFrame:
    """(community, internal): edges whose two ends are in one community. member: (id, community)."""
    a, b = member.select(F.col("id").alias("src"), F.col("community").alias("ca")), member.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    return graph.edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal"))


def type_modularity(graph: Graph) -> DataFrame:
    """Node types as communities: sum of internal/E - (size (size - 1) / 2E)^2; 0 without edges."""
    member = graph.nodes.select("id", F.coalesce("type", F.lit("unknown")).alias("community"))
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    total = graph.edges.agg(F.count("*").alias("e"))
    c = with_row(sizes.join(internal_edges(graph, member), "community", "left"), total)
    part = F.try_divide(F.coalesce("internal", F.lit(0)) * 1.0, F.col("e")) - F.pow(F.try_divide(F.col("size") * (F.col("size") - 1) * 1.0, 2 * F.col("e")), F.lit(2.0))
    return c.agg(F.count("*").alias("communities"), F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def component_modularity(graph: Graph) -> DataFrame:
    """Components of two nodes or more as communities: sum of internal/E - (degree^2 / 4E) / E; 0 without edges. A
    community's degree counts each edge once for each of its nodes."""
    member = materialize(connected(graph).withColumnRenamed("component", "community"))
    deg = endpoints(graph.edges, loops_once=True).groupBy("id").agg(F.count("*").alias("degree"))
    c = member.join(deg, "id", "left").groupBy("community").agg(F.count("*").alias("size"), F.coalesce(F.sum("degree"), F.lit(0)).alias("degree")).where("size > 1")
    total = graph.edges.agg(F.count("*").alias("e"))
    c = with_row(c.join(internal_edges(graph, member), "community", "left"), total)
    part = F.try_divide(F.coalesce("internal", F.lit(0)) * 1.0, F.col("e")) - F.try_divide(F.try_divide(F.col("degree") * F.col("degree") * 1.0, 4 * F.col("e")), F.col("e"))
    return c.agg(F.count("*").alias("communities"), F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def feature_clusters(nodes: DataFrame) -> DataFrame:
    """(type, bucket, n, avg_size): by type and size: small below 20, medium below 40, else large (also where missing)."""
    bucket = F.when(F.col("size") < 20, "small").when(F.col("size") < 40, "medium").otherwise("large")
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"))


def label_similarity(nodes: DataFrame, id1: str, id2: str) -> DataFrame:
    """Jaccard likeness of two nodes' label words (also what the semantic measure computes)."""
    a, b = (nodes.where(F.col("id") == i).select(tokens("label").alias(x)).limit(1) for i, x in ((id1, "a"), (id2, "b")))
    return with_row(a, b).select(jaccard(F.col("a"), F.col("b")).alias("similarity"))


def structural_similarity(edges: DataFrame, id1: str, id2: str) -> DataFrame:
    """Jaccard likeness of two nodes' neighbour sets, in any direction; 0 where neither has any."""
    own = adjacency(endpoints(edges).where(F.col("id").isin(id1, id2)).select(F.col("id").alias("src"), F.col("other").alias("dst"))).where(F.col("id").isin(id1, id2))
    side = F.array(F.lit(id1), F.lit(id2))
    sets = own.agg(*[F.coalesce(F.first(F.when(F.col("id") == F.get(side, i), F.col("neighbours")), ignorenulls=True), F.array().cast("array<string>")).alias(c) for i, c in enumerate(("a", "b"))])
    return sets.select(jaccard(F.col("a"), F.col("b")).alias("similarity"))


def cluster_links(graph: Graph, member: DataFrame) -> DataFrame:
    """(a, b, connections, strength): edges and their weight between two clusters, a < b. member: (id, cluster)."""
    ma, mb = member.select(F.col("id").alias("src"), F.col("cluster").alias("x")), member.select(F.col("id").alias("dst"), F.col("cluster").alias("y"))
    # by cluster and other end first: many edges meet the second end as one row
    half = graph.edges.join(ma, "src").groupBy("dst", "x").agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(1))).alias("w"))
    e = half.join(mb, "dst").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("connections"), F.sum("w").alias("strength"))


def structural_gaps(graph: Graph, member: DataFrame) -> DataFrame:
    """Weakly linked pairs of clusters (fewer connections than a tenth of the smaller size) and isolated clusters (no
    link to others, more than three nodes): (kind, a, b, connections)."""
    sizes = materialize(member.groupBy("cluster").agg(F.count("*").alias("size")))
    links = materialize(cluster_links(graph, member))
    sa, sb = sizes.select(F.col("cluster").alias("a"), F.col("size").alias("na")), sizes.select(F.col("cluster").alias("b"), F.col("size").alias("nb"))
    weak = links.join(sa, "a").join(sb, "b").where(F.col("connections") < 0.1 * F.least("na", "nb")).select(F.lit("weak").alias("kind"), "a", "b", "connections")
    touched = links.select(F.col("a").alias("cluster")).unionByName(links.select(F.col("b").alias("cluster"))).distinct()
    alone = sizes.where("size > 3").join(touched, "cluster", "left_anti").select(F.lit("isolated").alias("kind"), F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("long").alias("connections"))
    return weak.unionByName(alone)


def cluster_size_variance(member: DataFrame) -> DataFrame:
    return member.groupBy("cluster").agg(F.count("*").alias("size")).agg(F.coalesce(F.var_pop("size"), F.lit(0.0)).alias("variance"))


def network_bias(graph: Graph, member: DataFrame) -> DataFrame:
    """One row: density, variance of cluster sizes, kind of bias and its score."""
    s = with_row(structure(graph), cluster_size_variance(member))
    kind = F.when(F.col("density") < 0.01, "sparse").when(F.col("density") > 0.1, "dense").otherwise("balanced")
    score = F.when(F.col("density") < 0.01, 0.3).when(F.col("density") > 0.1, 0.8).otherwise(0.5)
    focused = F.col("variance") > 100
    return s.select("density", "variance", F.when(focused, "focused").otherwise(kind).alias("bias"), F.when(focused, F.greatest(score, F.lit(0.6))).otherwise(score).alias("score"))


def fallback_insights(graph: Graph, member: DataFrame) -> DataFrame:
    """Two templated rows: the kind of bias with the density in per cent, and the number of gaps."""
    b = network_bias(graph, member).select(F.format_string("Network structure is %s (density %.2f%%)", "bias", F.col("density") * 100).alias("insight"))
    g = structural_gaps(graph, member).agg(F.count("*").alias("n")).select(F.format_string("%d structural gaps between clusters", "n").alias("insight"))
    return b.unionByName(g)


def strongest(edges: DataFrame, k: int = 5) -> DataFrame:
    return edges.orderBy(F.coalesce("weight", F.lit(0)).desc(), "src", "dst").limit(k)


# Measures that the original names without defining; the definitions are ours.


def degree_outliers(graph: Graph, z: float = 3.0) -> DataFrame:
    """Nodes whose degree is more than z standard deviations above the mean."""
    d = degrees(graph).select("id", "degree")
    s = d.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("sd"))
    return with_row(d, s).withColumn("z", F.try_divide(F.col("degree") - F.col("m"), F.col("sd"))).where(F.col("z") > z).select("id", "degree", "z")


def trends(df: DataFrame, time: str, interval: str = "day", kind: str | None = None) -> DataFrame:
    """Rows per interval (and kind)."""
    keys = [F.date_trunc(interval, time).cast(df.schema[time].dataType).alias("period"), *([F.col(kind)] if kind else [])]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def common_neighbours(graph: Graph, id: str, k: int = 10) -> DataFrame:  # noqa: A002
    """Nodes that share most neighbours with a node and aren't linked to it."""
    known = lambda df, c: df.join(graph.nodes.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    ends = endpoints(graph.edges).where("id <> other")
    # its neighbours first: only what touches them is made distinct
    own = written(known(known(ends.where(F.col("id") == id), "id"), "other").select(F.col("other").alias("via")).distinct())
    two = known(ends.where(F.col("other") != id).join(own, ends["id"] == own["via"]).select("other", "via").distinct(), "other")
    two = two.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("shared"))
    return two.join(own, two["id"] == own["via"], "left_anti").orderBy(F.desc("shared"), "id").limit(k)


def analysis_bundle(graph: Graph, member: DataFrame, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Metrics, centrality, communities by components, gaps, bias and insights of a graph, without a language model. Components and gaps
    are computed at once, so name those parts that are wanted."""
    from .graph import communities
    from .topics import class_counts

    parts = {"metrics": lambda: network_metrics(graph), "centrality": lambda: degree_centrality(graph), "communities": lambda: communities(graph), "classes": lambda: class_counts(graph.nodes), "strongest": lambda: strongest(graph.edges), "gaps": lambda: structural_gaps(graph, member), "bias": lambda: network_bias(graph, member), "insights": lambda: fallback_insights(graph, member), "top": lambda: top_by(graph.nodes, "size", 10)}
    return {name: part() for name, part in parts.items() if only is None or name in only}


def betweenness(graph: Graph, pivots: DataFrame | None = None, max_hops: int = 50, block: int = 32) -> DataFrame:
    """(id, betweenness) of every node over edges in any direction: the sum over other pairs of nodes of the share of their
    shortest paths that run through it, each pair counted once. Parallel edges and self-loops don't matter, nodes that only
    an edge names are left out.

    Dependencies are accumulated from `pivots` (id): levels with path counts forwards, then dependency sums backwards level by
    level. Without pivots every node is one, which is exact. With k of n nodes as pivots, drawn at random, the sums are scaled by
    n / k; by Hoeffding's inequality a node's estimate is off by more than e * n (n - 2) / 2 with probability of at most
    2 exp(-2 e^2 k), as a pivot adds between 0 and n - 2. `block` pivots (at most 63) share a row, one column each, so rows are reach
    times blocks of pivots and an edge is sent once a level for all of a block: sample on large graphs. Nodes go by number. Paths of
    over max_hops edges are an error.
    """
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")).distinct(), ["name"], "id").select("id", "name"))
    n = names.count()
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    e = graph.edges.where("src <> dst").select("src", "dst").join(by("src", "a"), "src").join(by("dst", "b"), "dst")
    step = written(e.select(F.col("a").alias("at"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("at"), F.col("a").alias("to"))).distinct())
    start = names.select("id") if pivots is None else names.join(pivots.select(F.col("id").alias("name")).distinct(), "name", "left_semi").select("id")
    start = written(numbered(start, ["id"], "rank"))
    k = start.count()
    width = max(1, min(block, k))
    ps = [f"p{j}" for j in range(width)]
    none, some = [F.lit(0.0).alias(p) for p in ps], F.exists(F.array(*ps), lambda x: x > 0)
    mine = [F.when(F.col("rank") % width == j, 1.0).otherwise(0.0).alias(p) for j, p in enumerate(ps)]
    # whose level a node is on, as bits: an edge leads to the level before, the same or the next one
    bits = sum((F.when(F.col(p) > 0, 1 << j).otherwise(0).cast("long") for j, p in enumerate(ps)), F.lit(0).cast("long"))
    sums = [F.sum(p).alias(p) for p in ps]
    front = written(start.select(F.floor(F.col("rank") / width).alias("b"), "id", *mine))
    levels = []
    while not front.isEmpty():
        levels.append(front)
        if len(levels) > max_hops + 1:
            raise RuntimeError(f"shortest paths of over {max_hops} edges")
        sent = front.join(step, front["id"] == step["at"]).select("b", F.col("to").alias("id"), *ps, F.lit(0).cast("long").alias("seen"))
        for level in levels[-2:]:
            sent = sent.unionByName(level.select("b", "id", *none, bits.alias("seen")))
        reached = sent.groupBy("b", "id").agg(*sums, F.bit_or("seen").alias("seen"))
        new = [F.when(F.col("seen").bitwiseAND(F.lit(1 << j).cast("long")) == 0, F.col(p)).otherwise(0.0).alias(p) for j, p in enumerate(ps)]
        front = written(reached.select("b", "id", *new).where(some))
    back, total = None, None
    for level in reversed(levels[1:]):
        # the share of its dependency that a node hands to each path
        here = level.select("*", *[F.lit(0.0).alias(f"s{p}") for p in ps]) if back is None else level.join(back, ["b", "id"], "left").na.fill(0.0, [f"s{p}" for p in ps])
        delta = [F.col(p) * F.col(f"s{p}") for p in ps]
        share = [F.when(F.col(p) > 0, (1 + d) / F.col(p)).otherwise(0.0).alias(p) for p, d in zip(ps, delta, strict=True)]
        here = written(here.select("b", "id", *share, sum(delta, F.lit(0.0)).alias("delta")))
        total = here.select("id", "delta") if total is None else total.unionByName(here.select("id", "delta"))
        back = here.join(step, here["id"] == step["at"]).select("b", F.col("to").alias("id"), *ps).groupBy("b", "id").agg(*[F.sum(p).alias(f"s{p}") for p in ps])
    if total is None:
        return names.select(F.col("name").alias("id"), F.lit(0.0).alias("betweenness"))
    all_ = total.groupBy("id").agg(F.sum("delta").alias("b"))
    scale = (n / k if k else 0.0) / 2
    return names.join(all_, "id", "left").select(F.col("name").alias("id"), (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def sketched_closeness(graph: Graph, max_hops: int = 5, far: int = 999, log_size: int = 12) -> DataFrame:
    """closeness() of all nodes at once, estimated: each node keeps a HyperLogLog sketch of the nodes within h edges forwards and takes
    the union of those successors' sketches that the last hop changed, until none changes, so rows are nodes times hops whatever the reach. A count is off by about
    1.04 / sqrt(2^log_size), 1.6 % for 12; small ones are exact. A node that is wrongly taken as out of reach adds `far` to the
    distances, so the mean of a node that reaches a large part of the graph is off by that share of `far`. Columns and limits as
    of closeness(), reached is rounded.
    """
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")).distinct(), ["name"], "id").select("id", "name"))
    n = names.count()
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("id").alias(to))
    step = written(graph.edges.where("src <> dst").select("src", "dst").join(by("src", "at"), "src").join(by("dst", "to"), "dst").select("at", "to").distinct())
    now = names.groupBy("id").agg(F.hll_sketch_agg("name", log_size).alias("sketch"))
    now = written(now.select("id", "sketch", F.lit(0.0).alias("near"), F.lit(1.0).alias("count"), F.lit(True).alias("fresh")))
    for hop in range(1, max_hops + 1):
        # a sketch that the last hop didn't change has been told to all already
        told = now.where("fresh").select(F.col("id").alias("to"), "sketch")
        heard = step.join(told, "to").groupBy(F.col("at").alias("id")).agg(F.hll_union_agg("sketch").alias("heard"))
        both = F.when(F.col("heard").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "heard"))
        grown = now.join(heard, "id", "left").select("id", both.alias("sketch"), "near", "count", (both != F.col("sketch")).alias("fresh"))
        more = F.when(F.col("fresh"), F.greatest(F.hll_sketch_estimate("sketch").cast("double"), "count")).otherwise(F.col("count"))
        now = written(grown.select("id", "sketch", (F.col("near") + hop * (more - F.col("count"))).alias("near"), more.alias("count"), "fresh"))
        if now.where("fresh").isEmpty():
            break
    sums = now.join(names, "id").select(F.col("name").alias("id"), "near", "count")
    reached = F.least(F.col("count") - 1, F.lit(n - 1.0))
    mean = (F.col("near") + (F.lit(n - 1) - reached) * far) / F.lit(n - 1) if n > 1 else F.lit(float(far))
    return sums.select("id", F.round(reached).cast("long").alias("reached"), mean.alias("avg_distance")).withColumn("closeness", F.when(F.col("avg_distance") < far, 1 / F.col("avg_distance")).otherwise(0.0))
