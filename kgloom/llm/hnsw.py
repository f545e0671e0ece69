"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Distinct unit vectors are dealt to shards, bounded by rows and bytes; one graph is built per shard; blocks of queries
(every vector) stream past every shard's graph, which a task loads once, and search it with a beam. A beam whose worst member still is a link is widened and searched again; then a seeded audit
of queries compares the links found with a brute-force scan of the shard, and beams widen until its recall passes.
Cosines are verified in double precision. Copies of a vector enter the search once and count by their number. Searches
go in lock-step: numpy steps all queries of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

M, M0, EF_BUILD, EF = 12, 24, 48, 32
#: Queries whose links overrun the widest beam up to this are scored against the whole shard.
WIDE = 1024
#: A shard's rows, and bytes of its vectors in double precision: what one task holds. Rows of a block of queries, which
#: stream: a graph is sent once for each block, a vector once for each shard. Queries that are searched together.
SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS, MIN_SHARDS, CHUNK_ROWS = 65_536, 64 << 20, 262_144, 4, 16_384
BATCH = 512
NONE = -1


class Graph:
    """x: unit vectors (float32). links[level]: neighbours of each node of that level, padded with NONE."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        self.x, n = x, len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(M)).astype(int), 8) if n else np.zeros(0, int)
        order = np.argsort(-self.level, kind="stable")  # high nodes first: an upper level is complete before it is descended
        self.x, self.perm, self.level = x[order], order, self.level[order]
        top = int(self.level[0]) if n else 0
        self.links = [np.full((int((self.level >= lv).sum()), M0 if lv == 0 else M), NONE, np.int32) for lv in range(top + 1)]
        at = 1
        while at < n:
            end = min(n, at + min(BATCH, at))
            self._insert(at, end)
            at = end

    def _insert(self, a: int, b: int) -> None:
        q = self.x[a:b]
        entry = np.zeros((b - a, 1), np.int64)
        for lv in range(len(self.links) - 1, -1, -1):
            members = min(a, len(self.links[lv]))
            if not members:
                continue
            ids, sims = self.beam(q, entry, lv, EF_BUILD if lv == 0 or b > a else 8, limit=members)
            entry = ids[:, :4]
            which = np.flatnonzero(self.level[a:b] >= lv)
            if len(which):
                self._link(lv, a + which, ids[which], sims[which])

    def _link(self, lv: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[lv]
        width = links.shape[1]
        chosen = self._diverse(ids, sims, max(4, width // 2))
        links[nodes, : chosen.shape[1]] = chosen
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst != NONE], dst[dst != NONE]
        order = np.lexsort((-np.einsum("ed,ed->e", self.x[src], self.x[dst]), dst))  # the most similar of a target come first
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = min(int(count.max(initial=0)), 2 * width)
        grid = np.full((len(targets), width + extra), NONE, np.int64)
        grid[:, :width] = links[targets]
        col = np.arange(len(dst)) - np.repeat(first, count)
        ok = col < extra
        grid[np.repeat(np.arange(len(targets)), count)[ok], width + col[ok]] = src[ok]
        s = np.einsum("td,tkd->tk", self.x[targets], self.x[grid])
        s[grid == NONE] = -2
        best = np.argsort(-s, 1)
        links[targets] = self._diverse(np.take_along_axis(grid, best, 1), np.take_along_axis(s, best, 1), width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates (best first) those nearer to the node than to any kept one, then the best others."""
        n, c = ids.shape
        v = self.x[ids]
        kept_sim = np.full((n, c), -2.0, np.float32)
        state = np.zeros((n, c), np.int8)  # 1 kept, 2 passed over
        for j in range(c):
            good = (ids[:, j] != NONE) & (kept_sim[:, j] < sims[:, j]) & ((state == 1).sum(1) < keep)
            state[:, j] = np.where(good, 1, 2)
            rows = np.flatnonzero(good)
            if len(rows) and j + 1 < c:
                s = np.einsum("nd,nkd->nk", v[rows, j], v[rows, j + 1 :])
                kept_sim[rows[:, None], np.arange(j + 1, c)[None, :]] = np.maximum(kept_sim[rows, j + 1 :], s)
        rank = np.argsort(np.where(ids == NONE, 3, state), 1, kind="stable")[:, :keep]
        return np.take_along_axis(ids, rank, 1)

    def beam(self, q: np.ndarray, entry: np.ndarray, lv: int, ef: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found for each query, best first (NONE, -2 where fewer). entry may hold NONE."""
        links = self.links[lv]
        n = len(links) if limit is None else limit
        nq = len(q)
        seen = np.zeros((nq, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(nq)[:, None]
        first = np.where(entry == NONE, n, entry)
        fresh = ~seen[rows, first]
        seen[rows, first] = True
        ids = np.full((nq, ef), NONE, np.int64)
        sims, done = np.full((nq, ef), -2.0, np.float32), np.ones((nq, ef), bool)
        s = np.where(fresh, np.einsum("qd,qkd->qk", q, self.x[np.minimum(first, max(n - 1, 0))]), -2)
        width = min(ef, entry.shape[1])
        best = np.argsort(-s, 1)[:, :width]
        sims[:, :width] = np.take_along_axis(s, best, 1)
        ids[:, :width] = np.where(sims[:, :width] > -2, np.take_along_axis(first, best, 1), NONE)
        done[:, :width] = ids[:, :width] == NONE
        live = np.arange(nq)
        while len(live):
            open_ = ~done[live]
            live = live[open_.any(1)]
            if not len(live):
                break
            pick = (~done[live]).argmax(1)  # best first, so the first open one is the best
            done[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            near[(near == NONE) | (near >= n)] = n
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            s = np.einsum("qd,qkd->qk", q[live], self.x[np.where(fresh, near, 0)])
            s[~fresh | (s <= sims[live, -1:])] = -2
            some = (s > -2).any(1)
            if not some.any():
                continue
            at, s, near = live[some], s[some], near[some]
            all_s = np.concatenate([sims[at], s], 1)
            all_i = np.concatenate([ids[at], near], 1)
            all_d = np.concatenate([done[at], s == -2], 1)
            best = np.argsort(-all_s, 1, kind="stable")[:, :ef]
            sims[at] = np.take_along_axis(all_s, best, 1)
            ids[at] = np.where(sims[at] > -2, np.take_along_axis(all_i, best, 1), NONE)
            done[at] = np.take_along_axis(all_d, best, 1) | (sims[at] == -2)
        return ids, sims

    def unreached(self) -> np.ndarray:
        """Nodes that no walk over the lowest level reaches from the first node: no beam is sure to find them."""
        seen = np.zeros(len(self.x), bool)
        front = np.zeros(min(1, len(self.x)), np.int64)
        while len(front):
            seen[front] = True
            near = np.unique(self.links[0][front])
            near = near[near != NONE]
            front = near[~seen[near]]
        return np.flatnonzero(~seen)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for lv in range(len(self.links) - 1, 0, -1):
            entry = self.beam(q, entry, lv, 8)[0]
        first = np.where((entry == 0).any(1, keepdims=True), NONE, 0)  # the first node is always an entry, as unreached() assumes
        return self.beam(q, np.concatenate([entry, first], 1), 0, max(ef, 9))

    def to_bytes(self) -> bytes:
        return b"".join([np.array([len(self.x), self.x.shape[1], len(self.links)], "<i8").tobytes(), self.x.astype("<f4").tobytes(), self.perm.astype("<i8").tobytes(), np.array([len(a) for a in self.links], "<i8").tobytes(), *(a.astype("<i4").tobytes() for a in self.links)])

    @staticmethod
    def from_bytes(raw: bytes) -> Graph:
        g = Graph.__new__(Graph)
        n, d, levels = np.frombuffer(raw, "<i8", 3).tolist()
        at = 24
        g.x = np.frombuffer(raw, "<f4", n * d, at).reshape(n, d)
        at += 4 * n * d
        g.perm = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        sizes = np.frombuffer(raw, "<i8", levels, at).tolist()
        at += 8 * levels
        g.links = []
        for lv, k in enumerate(sizes):
            w = M0 if lv == 0 else M
            g.links.append(np.frombuffer(raw, "<i4", k * w, at).reshape(k, w))
            at += 4 * k * w
        return g


def scanned(x: np.ndarray, q: np.ndarray, which: np.ndarray, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, indices of x whose cosine reaches floor) of the queries in which, by a blocked matrix product."""
    step = max(1, (1 << 24) // max(len(x), 1))
    for at in range(0, len(which), step):
        part = which[at : at + step]
        for i, row in zip(part.tolist(), (q[part] @ x.T) >= floor, strict=True):
            yield i, np.flatnonzero(row)


def linked(g: Graph, q: np.ndarray, floor: float, target: float, seed: int, audit: int = 128) -> Iterator[tuple[int, np.ndarray]]:
    """(query, nodes whose float32 cosine reaches floor) of each query that has any. Beams widen until they overrun the
    links, and all of them again until the audits' recall reaches target. Queries whose links fill the widest beam, and
    all of them where audits fail with such a beam, are scored against the whole shard; every query is scored against the
    nodes that the graph doesn't reach."""
    n, ef = len(g.x), EF
    lost, left = g.unreached(), np.arange(len(q))
    while True:
        found: dict[int, np.ndarray] = {}
        top = np.full(len(q), -2.0, np.float32)
        todo, wide, hot = left, ef, []
        while len(todo):
            again = []
            step = max(1, min(BATCH, (1 << 25) // max(n, 8 * wide)))
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                ids, sims = g.search(q[part], min(wide, n))
                top[part] = sims[:, 0]
                hit = (sims >= floor).sum(1)
                for i in np.flatnonzero(hit):
                    if hit[i] < sims.shape[1] or wide >= n:
                        found[int(part[i])] = ids[i, : hit[i]].astype(np.int32)  # a copy, so the beam can go
                    else:
                        (again if wide * 4 <= WIDE else hot).append(part[i])
            todo, wide = np.array(again, np.int64), wide * 4
        if hot:  # exact, so they need no audit and never come back
            yield from scanned(g.x, q, np.array(hot, np.int64), floor)
            left = np.setdiff1d(left, hot)
        if len(lost):
            for i, more in scanned(g.x[lost], q, left, floor):
                if len(more):
                    found[i] = np.union1d(found.get(i, np.zeros(0, np.int32)), lost[more])
        if not len(left):
            return
        rng = np.random.default_rng(seed)
        near = left[np.argsort(-top[left], kind="stable")][: 4 * audit]  # where links are, a second audit looks
        passed = True
        for sample in (rng.permutation(left)[:audit], rng.permutation(near)[: audit // 2]):
            want = got = 0
            for i, all_ in scanned(g.x, q, sample, floor):
                want += len(all_)
                got += len(np.intersect1d(all_, found[i])) if i in found else 0
            passed &= got >= target * want
        if passed:
            yield from found.items()
            return
        ef *= 2
        if ef > min(WIDE, n):
            yield from ((i, ids) for i, ids in scanned(g.x, q, left, floor) if len(ids))
            return


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, u, h1, h2): unit vectors in double precision and 128 bits of their hash, null where a vector links with nothing."""
    for b in batches:
        v = b.column(1)
        flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy().astype(np.int64)  # a null component is NaN
        size = np.where(v.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        u: list = [None] * len(v)
        for n in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == n)
            x = flat[ends[rows][:, None] + np.arange(n)]
            most = np.abs(x).max(1)  # divided by first, so that no square overflows or vanishes
            good = np.isfinite(most) & (most > 0)
            x = np.where(good[:, None], x, 1.0) / np.where(good, most, 1.0)[:, None]
            norm = np.sqrt((x * x).sum(1))
            for i, unit in zip(rows[good].tolist(), x[good] / norm[good, None] + 0.0, strict=True):  # no negative zero
                u[i] = unit
        h = [None if x is None else xxhash.xxh3_128_intdigest(x.tobytes()) for x in u]
        cut = lambda f: pa.array([None if x is None else f(x) - (1 << 63) for x in h], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u, pa.list_(pa.float64())), cut(lambda x: x >> 64), cut(lambda x: x & (1 << 64) - 1)], ["id", "u", "h1", "h2"])


def _linked_counts(g: Graph, reps: np.ndarray, copies: np.ndarray, exact: np.ndarray, ids: np.ndarray, q: np.ndarray, threshold: float, recall: float, seed: int) -> list[tuple[int, int, int]]:
    """(query, query, number of linked vectors) and (query, node, 0) of a spanning forest of the links, for components."""
    out: list[tuple[int, int, int]] = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, nodes in linked(g, q.astype(np.float32), threshold - 1e-4, recall, seed):
        nodes = g.perm[nodes]
        nodes = nodes[(exact[nodes] @ q[i] >= threshold) & (reps[nodes] != ids[i])]
        if len(nodes):
            out.append((int(ids[i]), int(ids[i]), int(copies[nodes].sum())))
            for b in np.unique(reps[nodes]).tolist():
                x, y = find(int(ids[i])), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), b, 0))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, min_shards: int = MIN_SHARDS, shard_bytes: int = SHARD_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing.
    Equal unit vectors (also of different lengths, so not only copies) link with each other; they are told by 128 bits of
    hash. Vectors of unequal dimension never link. Rows that repeat an id are vectors of their own. Empty table: no rows.
    """
    units = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(_units, "id long, u array<double>, h1 long, h2 long")
    classes = units.where("u is not null").groupBy("h1", "h2").agg(F.any_value("u").alias("u"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes).withColumn("rep", F.monotonically_increasing_id())  # over a checkpoint, so every reading gives the same
    rows = units.select("id", "h1", "h2")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dim")).first()
    shard_rows = max(1, min(shard_rows, shard_bytes // (8 * (shape["dim"] or 1))))
    shards, blocks = max(min_shards, -(-shape["n"] // shard_rows)), max(min_shards, -(-shape["n"] // block_rows))
    pool = classes.select("rep", "copies", "u", F.size("u").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(blocks)).cast("int").alias("block"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        g = Graph(np.stack(pdf["u"].to_numpy()).astype(np.float32))
        return pd.DataFrame([[pdf["dim"].iloc[0], pdf["shard"].iloc[0], g.to_bytes(), pdf["rep"].to_numpy("<i8").tobytes(), pdf["copies"].to_numpy("<i8").tobytes(), np.stack(pdf["u"].to_numpy()).astype("<f8").tobytes()]], columns=["dim", "shard", "graph", "reps", "copies", "exact"])

    graphs = materialize(pool.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary, reps binary, copies binary, exact binary"))
    sides = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).cast("long").alias("rep"), F.lit(None).cast("array<double>").alias("u"), "graph", "reps", "copies", "exact")
    none = [F.lit(None).cast("binary").alias(c) for c in ("graph", "reps", "copies", "exact")]
    queries = pool.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "rep", "u", *none)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: a shard's graph comes first (rep -1), then the queries of a block."""
        def answered(held: tuple | None, key: tuple, ids: list[int], q: list[np.ndarray]) -> pa.RecordBatch:
            found = _linked_counts(*held, np.array(ids), np.stack(q), threshold, recall, key[1]) if held and ids else []
            xy = np.array(found, np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(xy[:, i]) for i in range(3)], ["a", "b", "n"])

        key, held, ids, q = None, None, [], []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            reps, u = b.column(3).to_pylist(), b.column(4)
            flat, ends = u.values.to_numpy(), u.offsets.to_numpy()
            for i, (k, rep) in enumerate(zip(keys, reps, strict=True)):
                if k != key or len(ids) >= chunk_rows:
                    yield answered(held, key, ids, q)
                    ids, q = [], []
                    key, held = k, held if k == key else None
                if rep < 0:
                    g, *parts = (b.column(c)[i].as_buffer() for c in (5, 6, 7, 8))
                    held = (Graph.from_bytes(g.to_pybytes()), *(np.frombuffer(x.to_pybytes(), t) for x, t in zip(parts[:2], ("<i8", "<i8"), strict=True)), np.frombuffer(parts[2].to_pybytes(), "<f8").reshape(-1, k[0]))
                else:
                    ids.append(rep)
                    q.append(flat[ends[i] : ends[i + 1]].copy())
        if key is not None:
            yield answered(held, key, ids, q)

    keys = ["dim", "shard", "block"]
    found = materialize(sides.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(search, "a long, b long, n long"))
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(classes.select(F.col("rep").alias("id")), found.select("a", "b"))
    named = materialize(classes.select("rep", "h1", "h2", "copies", "least").join(comp.withColumnRenamed("id", "rep"), "rep").join(degree, "rep", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", "least"))
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_rows = rows.where("h1 is not null").join(named.join(top, "component").select("h1", "h2", "n_links", "component_id"), ["h1", "h2"]).select("id", "n_links", "component_id")
    return linked_rows.unionByName(rows.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
