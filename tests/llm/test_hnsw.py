"""The HNSW search of one shard against a full scan."""

import numpy as np
import pytest

from kgloom.llm import hnsw


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def scan(x, q, floor):
    return {i: set(np.flatnonzero(row).tolist()) for i, row in enumerate(q @ x.T >= floor) if row.any()}


@pytest.mark.parametrize("cut", ["all", "some", "none"])
def test_unreached_nodes(cut):
    rng = np.random.default_rng(1)
    g = hnsw.Graph(unit(rng.normal(size=(600, 16)) * 0.1 + rng.normal(size=(6, 16))[np.arange(600) % 6]))
    links = g.links[0].copy()
    if cut == "all":
        links[:] = hnsw.NONE
    elif cut == "some":
        links[np.isin(links, np.arange(100, 130))] = hnsw.NONE  # nodes without any incoming link
    g.links[0] = links
    got = {i: set(ids.tolist()) for i, ids in hnsw.linked(g, g.x, 0.9, 0.995, 1) if len(ids)}
    want = scan(g.x, g.x, 0.9)
    hit, total = sum(len(got.get(i, set()) & w) for i, w in want.items()), sum(map(len, want.values()))
    assert all(got[i] <= want[i] for i in got)
    assert hit == total if cut == "all" else hit >= 0.995 * total
    if cut == "some":
        assert all(set(range(100, 130)) & w <= got[i] for i, w in want.items() if set(range(100, 130)) & w)


def test_links_past_the_widest_beam(monkeypatch):
    rng = np.random.default_rng(2)
    x = unit(np.concatenate([rng.normal(size=(700, 16)) * 0.03 + 1, rng.normal(size=(500, 16))]))
    g = hnsw.Graph(x)
    monkeypatch.setattr(hnsw, "WIDE", 128)
    widths, search = [], hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, ef: widths.append(ef) or search(self, q, ef))
    got = {i: set(ids.tolist()) for i, ids in hnsw.linked(g, g.x, 0.9, 0.995, 1) if len(ids)}
    want = scan(g.x, g.x, 0.9)
    assert max(widths) <= 128
    assert all(got[i] == w for i, w in want.items() if len(w) > 128)
    assert sum(len(got.get(i, set()) & w) for i, w in want.items()) >= 0.995 * sum(map(len, want.values()))
