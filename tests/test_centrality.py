"""Betweenness and sketched closeness against plain computations."""

import random
from collections import defaultdict, deque

from kgloom.operators import graph, metrics
from kgloom.operators.graph import Graph
from kgloom.sources import tables

NODES, EDGES = "id string", "src string, dst string"


def plain_betweenness(ids, edges, pivots):
    near = defaultdict(set)
    for a, b in edges:
        if a != b and a in ids and b in ids:
            near[a].add(b)
            near[b].add(a)
    out = dict.fromkeys(ids, 0.0)
    for s in pivots:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return {v: b * len(ids) / len(pivots) / 2 for v, b in out.items()}


def test_betweenness(spark):
    rng = random.Random(1)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("n00", "n01")] * 3 + [("n00", "gone"), ("n05", "n05")]
    g = Graph(spark.createDataFrame([(i,) for i in [*ids, ids[0]]], NODES), spark.createDataFrame(edges, EDGES))
    for pivots in (None, ids[::7]):
        p = None if pivots is None else spark.createDataFrame([(i,) for i in [*pivots, "gone"]], NODES)
        got = {r["id"]: round(r["betweenness"], 9) for r in metrics.betweenness(g, p).collect()}
        assert got == {i: round(b, 9) for i, b in plain_betweenness(set(ids), edges, pivots or ids).items()}
    assert {r["betweenness"] for r in metrics.betweenness(Graph(g.nodes, g.edges.limit(0))).collect()} == {0.0}
    assert metrics.betweenness(Graph(g.nodes.limit(0), g.edges)).count() == 0


def test_betweenness_of_the_test_graph(spark, sf):
    """All nodes of the places' graph as pivots."""
    g = tables.geo_graph(spark, sf)
    ids, edges = {r["id"] for r in g.nodes.collect()}, [(r["src"], r["dst"]) for r in g.edges.collect()]
    want = plain_betweenness(ids, edges, sorted(ids))
    got = {r["id"]: r["betweenness"] for r in metrics.betweenness(g).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, want[i]) for i in ids)


def test_sketched_closeness(spark, sf):
    """Against the exact query on the whole graph, and on one whose nodes reach thousands of others."""
    hub = [("h", f"m{i}") for i in range(60)] + [(f"m{i}", f"x{i}_{j}") for i in range(60) for j in range(80)] + [("m0", "h"), ("h", "h")]
    wide = Graph(spark.createDataFrame([(i,) for i in sorted({x for e in hub for x in e} | {"alone"})], NODES), spark.createDataFrame(hub, EDGES))
    for g in (tables.graph(spark, sf), wide):
        want = {r["id"]: r for r in graph.closeness(g).collect()}
        got = {r["id"]: r for r in metrics.sketched_closeness(g).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert abs(got[i]["reached"] - w["reached"]) <= 0.03 * w["reached"]
            far = 999 * 0.03 * w["reached"] / (len(want) - 1)  # what is wrongly out of reach
            assert abs(got[i]["avg_distance"] - w["avg_distance"]) <= (0.03 * w["avg_distance"] if g is not wide else far)
    assert metrics.sketched_closeness(Graph(wide.nodes.limit(0), wide.edges)).count() == 0


def test_betweenness_in_blocks_of_pivots(spark):
    """Pivots that share rows, a column each, count as they do alone."""
    rng = random.Random(4)
    ids = [f"n{i:02d}" for i in range(30)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)]
    g = Graph(spark.createDataFrame([(i,) for i in ids], NODES), spark.createDataFrame(edges, EDGES))
    want = {i: round(b, 9) for i, b in plain_betweenness(set(ids), edges, ids[:5]).items()}
    for block in (1, 3, 63):
        got = metrics.betweenness(g, g.nodes.where("id < 'n05'"), block=block)
        assert {r["id"]: round(r["betweenness"], 9) for r in got.collect()} == want


def test_sketches_are_told_until_none_changes(spark, monkeypatch):
    """Hops end with the first that changes no sketch, and a bundle computes only what is asked for."""
    g = Graph(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double"))
    calls, written = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda df: calls.append(1) or written(df))
    got = {r["id"]: r["reached"] for r in metrics.sketched_closeness(g, max_hops=50).collect()}
    assert got == {"a": 2, "b": 1, "c": 0} and len(calls) < 8
    member = g.nodes.withColumn("cluster", g.nodes["id"])
    assert set(metrics.analysis_bundle(g, member, ("insights",))) == {"insights"}
