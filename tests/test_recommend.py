"""Recommendations for all nodes against brute force."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from kgloom.operators import recommend
from kgloom.operators.graph import Graph
from kgloom.sources import tables

EDGES = "src string, dst string, weight double"


def brute(ids, edges, k):
    vec = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        w = w if w is not None and 0 < w < float("inf") else 1.0
        if a != b and a in ids and b in ids:
            vec[a][b] += w
            vec[b][a] += w
    sq = {a: sum(w * w for w in v.values()) for a, v in vec.items()}
    out = {}
    for a, v in vec.items():
        dots = defaultdict(float)
        for b, w in v.items():
            for c, x in vec[b].items():
                if c != a and c not in v:
                    dots[c] += w * x
        best = sorted((-round(d / (sq[a] * sq[c]) ** 0.5, 9), c) for c, d in dots.items())[:k]
        out |= {(a, r): (c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


def rows(df):
    return {(r["id"], r["rank"]): (r["recommended"], r["score"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
    assert all(abs(got[x][1] - want[x][1]) < 2e-9 for x in want)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    """A hub linked to a third of all, nodes of equal neighbours, odd weights, loops, unknown and parallel links, small blocks."""
    monkeypatch.setattr(recommend, "BLOCK", 7)
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(60)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice([1.0, 2.0, 3.0, 9.0, None, -1.0, 0.0])) for _ in range(110)]
    edges += [("n00", f"n{i:02d}", 5.0) for i in range(20, 40)] + [(f"t{i}", "n01", 1.0) for i in range(9)] + [("n02", "gone", 1.0), ("n03", "n03", 4.0)]
    ids += [f"t{i}" for i in range(9)] + ["alone"]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, EDGES))
    same(rows(recommend.recommendations(g, 3, probe=2)), brute(set(ids), edges, 3))


def test_empty(spark):
    g = Graph(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], EDGES))
    assert rows(recommend.recommendations(g)) == {}


def test_whole_graph(spark, sf):
    g = tables.graph(spark, sf)
    ids = {r["id"] for r in g.nodes.collect()}
    edges = [(r["src"], r["dst"], r["weight"]) for r in g.edges.collect()]
    same(rows(recommend.recommendations(g, 10)), brute(ids, edges, 10))


@pytest.mark.parametrize(("entries", "long", "cells"), [(40, 1 << 18, 64), (60, 12, 1 << 18)])
def test_blocks(spark, entries, long, cells, monkeypatch):
    """Pairs of small blocks, matrices of a few rows, and nodes too long for a block; no product of two links is a row of its own
    unless a node is too long."""
    monkeypatch.setattr(recommend, "LONG", long)
    monkeypatch.setattr(recommend, "CELLS", cells)
    monkeypatch.setattr(recommend, "ENTRIES", entries)
    monkeypatch.setattr(recommend, "LEAST", 1)
    wedges, calls = recommend._wedges, []
    monkeypatch.setattr(recommend, "_wedges", lambda *a: (calls.append(1), wedges(*a))[1])
    rng = random.Random(entries)
    ids = [f"n{i:02d}" for i in range(50)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice([1.0, 2.0, 3.0, None])) for _ in range(150)]
    edges += [("n00", f"n{i:02d}", 5.0) for i in range(20, 40)] + [(f"t{i}", "n01", 1.0) for i in range(9)] + [("n02", "gone", 1.0)]
    ids += [f"t{i}" for i in range(9)] + ["alone"]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, EDGES))
    same(rows(recommend.recommendations(g, 3)), brute(set(ids), edges, 3))
    assert bool(calls) == (long == 12)


@pytest.mark.parametrize(("cells", "half"), [(1 << 30, False), (0, False), (0, True)])
def test_rows_meet_chunks(cells, half, monkeypatch):
    """Only a node's best leave a block, however many chunks it meets; before, each pair of blocks put out k + 1 a node. Sums by matrix, by
    sorted whole numbers and by sorted fractions are the same."""
    monkeypatch.setattr(recommend, "CELLS", cells)
    monkeypatch.setattr(recommend, "PRODUCTS", 50)
    rng = random.Random(cells)
    rows = {c: {d: rng.randint(1, 3) + half / 2 for d in rng.sample(range(100, 130), 9)} for c in range(40)}
    rows[7][25] = rows[25][107] = 1.0  # 7 is linked to 25
    sq = {c: float(sum(w * w for w in v.values())) for c, v in rows.items()}
    chunks = []
    for at in range(0, 40, 8):
        e = [(c, d, float(w), sq[c]) for c in range(at, at + 8) for d, w in rows[c].items()]
        t = pa.table({"block": [0] * len(e), "chunk": [at] * len(e)} | dict(zip(("cls", "dim", "w", "sq"), map(list, zip(*e)), strict=True)))
        p = recommend._packed(0)(t)
        assert set(p["near"][0].as_py()) == {x[1] for x in e}
        chunks.append(recommend.pickle.loads(pa.decompress(p["data"][0].as_buffer(), decompressed_size=p["size"][0].as_py(), codec="zstd", asbytes=True)))
    block = recommend._Rows(chunks[:2], 3)
    for c in chunks:
        block.meet(c)
    got = defaultdict(list)
    for r in block.best().to_pylist():
        got[r["a"]].append((-round(r["s"], 9), r["c"]))
    assert got.keys() == set(range(16))
    for a in range(16):
        want = sorted((-round(sum(w * rows[c].get(d, 0) for d, w in rows[a].items()) / (sq[a] * sq[c]) ** 0.5, 9), c) for c in rows if c != a and c not in rows[a] and rows[a].keys() & rows[c].keys())
        assert sorted(got[a])[:4] == want[:4] and len(got[a]) < 12
