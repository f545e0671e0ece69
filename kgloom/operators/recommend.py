"""Recommendations: for every node, the nodes not linked to it whose weighted neighbours are most like its own."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph
from .iterate import numbered, written

#: Entries of a dimension that meet in one block of pairs.
BLOCK = 1024
#: Products that a task should make.
TASK = 1 << 24
#: Entries of a block of nodes, which a task holds, and chunks that a block is sent in, of which a task holds one beside its block.
ENTRIES, CHUNKS = 1 << 22, 8
#: Blocks of fewer entries aren't worth a call of Python.
LEAST = 1 << 12
#: Nodes of more entries than this are no part of a block.
LONG = 1 << 18
#: Products that are added up at once, so that they stay in a core's cache, and pairs a product up to which sums are a matrix of all pairs;
#: where there are more, products are sorted.
CELLS, PRODUCTS = 6, 1 << 17
#: Ranges of dimensions, as a power of two, by which a chunk is sent to the blocks that can need it.
RANGES = 12
#: What scores, rounded to nine digits, may be apart from their exact values, with room to spare.
SLACK = 1e-8


def _classes(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(number, name) of every node in the order of ids, (id, cls) of every linked node and (id, other, w), all by number. Nodes of
    equal weighted neighbours are one class, named by its least: none of them can be linked to another, and a link to one
    is a link to all."""
    names = written(numbered(graph.nodes.select(F.col("id").alias("name")), ["name"], "number").select("number", "name"))
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")).otherwise(1.0)
    by = lambda c, to: names.select(F.col("name").alias(c), F.col("number").alias(to))
    e = graph.edges.where("src <> dst").select("src", "dst", weight.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")).join(by("src", "a"), "src").join(by("dst", "b"), "dst")
    entries = written(e.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("other"), "w")).groupBy("id", "other").agg(F.sum("w").alias("w")))
    mark = lambda *salt: F.sum(F.xxhash64("other", "w", *salt).cast("decimal(38,0)"))
    marks = entries.groupBy("id").agg(mark().alias("x"), mark(F.lit(1)).alias("y"), F.count("*").alias("n"))
    least = marks.groupBy("x", "y", "n").agg(F.min("id").alias("cls"))
    return names, written(marks.join(least, ["x", "y", "n"]).select("id", "cls")), entries


def _wedges(asked: DataFrame, given: DataFrame) -> DataFrame:
    """(a, c, dot) summed over the dimensions that asked and given share. A dimension's entries are cut into blocks of about
    BLOCK, and every pair of blocks is a key of its own, so that a hub's work is spread however many nodes it has. Tasks are as many as the products need: by the few bytes of the entries, which
    is all that adaptive execution sees, one task would make them all."""
    spark, per = asked.sparkSession, lambda df, n: df.groupBy("dim").agg(F.count("*").cast("double").alias(n))
    products = per(asked, "x").join(per(given, "y"), "dim").agg(F.sum(F.col("x") * F.col("y")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(products / TASK))
    cuts = F.ceil(F.col("n") / BLOCK).cast("int")
    block = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), cuts).cast("int")
    every = F.explode(F.sequence(F.lit(0), cuts - 1))
    left = asked.select("dim", F.col("cls").alias("a"), F.col("w").alias("wa"), block("cls", 1).alias("i"), every.alias("j"))
    right = given.select("dim", F.col("cls").alias("c"), F.col("w").alias("wc"), block("cls", 2).alias("j"), every.alias("i"))
    left, right = left.repartition(parts, "dim", "i", "j"), right.repartition(parts, "dim", "i", "j")
    return left.join(right, ["dim", "i", "j"]).groupBy("a", "c").agg(F.sum(F.col("wa") * F.col("wc")).alias("dot"))


def _blocks(reps: DataFrame) -> tuple[DataFrame, int]:
    """(cls, block, chunk) of nodes of at most LONG entries (cls, n, center), and how many blocks there are, numbered from 0. Nodes of
    about as many entries stand in the order of the mean number of their neighbours, so that nodes with common neighbours mostly
    stand in few chunks; results don't depend on it."""
    placed = written(numbered(reps.withColumn("band", F.floor(F.log2("n")).cast("int")), ["band", "center", "cls"], "at"))
    bands = placed.groupBy("band").agg(F.min("at").alias("first"), F.count("*").alias("many"), F.sum("n").alias("sum")).orderBy("band").collect()  # at most 19 rows
    size, cuts, begin = min(ENTRIES, max(LEAST, sum(r["sum"] for r in bands) // 16)), [], 0
    for r in bands:
        cuts.append((r["band"], r["first"], r["many"], math.ceil(r["sum"] / size), begin))
        begin += cuts[-1][3]
    cut = F.broadcast(reps.sparkSession.createDataFrame(cuts, "band int, first long, many long, blocks long, begin long"))
    placed = placed.join(cut, "band").withColumn("chunk", F.floor((F.col("at") - F.col("first")) * F.col("blocks") * CHUNKS / F.col("many")).cast("long") + F.col("begin") * CHUNKS)
    return placed.select("cls", F.floor(F.col("chunk") / CHUNKS).cast("int").alias("block"), "chunk"), begin


def _packed(shift: int) -> Callable[[pa.Table], pa.Table]:
    """One row of each chunk: its entries by dimension, compressed, and the ranges of 2^shift numbers that its dimensions are in."""

    def run(t: pa.Table) -> pa.Table:
        cls, dim, w, sq = (t[c].to_numpy() for c in ("cls", "dim", "w", "sq"))
        order = np.lexsort((cls, dim))
        nodes, first, col = np.unique(cls, return_index=True, return_inverse=True)
        dims, many = np.unique(dim, return_counts=True)
        col, w = col[order].astype(np.int32), w[order]
        if w.max() < 256 and (w == np.floor(w)).all():
            w = w.astype(np.uint8)
        raw = pickle.dumps((nodes, sq[first], dims, many.astype(np.int32), col, w))
        data = pa.compress(raw, codec="zstd", asbytes=True)
        return pa.table({"block": t["block"][:1], "chunk": t["chunk"][:1], "size": pa.array([len(raw)], pa.int64()), "data": pa.array([data], pa.binary()), "near": pa.array([np.unique(dims >> shift)], pa.list_(pa.int64()))})

    return run


class _Rows:
    """The nodes of a block with all their entries, and the best of what they have met so far."""

    def __init__(self, chunks: list[tuple], k: int) -> None:
        self.k, (nodes, sq, dims, many, col, w) = k, zip(*chunks, strict=True)
        base = np.cumsum([0, *map(len, nodes)])
        self.names, self.sq, w = np.concatenate(nodes), np.concatenate(sq), np.concatenate(w)
        dim, row = np.concatenate([np.repeat(d, n) for d, n in zip(dims, many, strict=True)]), np.concatenate([c + b for c, b in zip(col, base, strict=False)])
        self.dims, at = np.unique(dim, return_inverse=True)
        order = np.lexsort((at, row))
        self.row, self.at, self.w = row[order].astype(np.int64), at[order].astype(np.int32), w[order]
        self.ends = np.searchsorted(self.row, np.arange(len(self.names) + 1))
        self.least, self.found, self.size = np.full(len(self.names), -1.0), [], 0

    def links(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether the nodes i are linked to those that are the dimensions d (-1: none of theirs)."""
        out, some = np.zeros(len(i), bool), np.flatnonzero(d >= 0)
        if len(some):
            if not hasattr(self, "keys"):
                self.keys = self.row * len(self.dims) + self.at
            asked = i[some] * len(self.dims) + d[some]
            out[some] = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
        return out

    def meet(self, chunk: tuple) -> None:
        """Adds up the products with a chunk, some rows at a time. Of each node those that rounding can leave among its k + 1 best are
        kept; of equal scores the k + 1 least are enough."""
        nodes, sq, dims, many, col, w = chunk
        place = np.minimum(np.searchsorted(self.dims, dims), len(self.dims) - 1)
        here = self.dims[place] == dims
        begin, n = np.zeros(len(self.dims), np.int64), np.zeros(len(self.dims), np.int64)
        begin[place[here]], n[place[here]] = (np.cumsum(many) - many)[here], many[here]
        total = np.concatenate([[0], np.cumsum(n[self.at])])
        products, width = total[self.ends], len(nodes)
        link = np.minimum(np.searchsorted(self.dims, nodes), len(self.dims) - 1)
        link = np.where(self.dims[link] == nodes, link, -1)
        whole = self.w.dtype.kind == w.dtype.kind == "u"  # both below 2^8
        col = col.astype(np.int64)
        kind = np.int64 if whole else np.float64
        w, mine, lo, rows = w.astype(kind), self.w, 0, len(self.names)
        while lo < rows:
            if products[lo] == products[-1]:
                break
            lo = int(np.searchsorted(products, products[lo], "right")) - 1  # nodes without products are passed over
            hi = min(max(lo + 1, int(np.searchsorted(products, products[lo] + PRODUCTS, "right")) - 1), rows)
            part = slice(self.ends[lo], self.ends[hi])
            at, own = self.at[part], mine[part].astype(kind)
            p = n[at]
            from_ = np.repeat(begin[at] - (np.cumsum(p) - p), p)
            from_ += np.arange(len(from_))
            key = np.repeat((self.row[part] - lo) * width, p)
            key += col[from_]
            value = np.repeat(own, p)
            value *= w[from_]
            cells = (hi - lo) * width
            if cells <= CELLS * len(key):
                m = np.bincount(key, value, cells)
                key = np.flatnonzero(m)
                dot = m[key]
            elif whole:
                key <<= 16
                key |= value
                key.sort()
                value = key & 0xFFFF
                key >>= 16
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                dot, key = np.add.reduceat(value, new), key[new]
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                dot, key = np.add.reduceat(value[order], new), key[new]
            i = key // width
            j = key - i * width
            s = dot / np.sqrt(self.sq[lo:hi][i] * sq[j])
            self.keep(lo, hi, i, j, s, nodes, link)
            lo = hi

    def keep(self, lo: int, hi: int, i: np.ndarray, j: np.ndarray, s: np.ndarray, nodes: np.ndarray, link: np.ndarray) -> None:
        least = self.least[lo:hi]
        some = s >= least[i] - SLACK
        i, j, s = i[some], j[some], s[some]
        out = (self.names[lo:hi][i] == nodes[j]) | self.links(i + lo, link[j])
        if out.any():
            i, j, s = i[~out], j[~out], s[~out]
        ordered = np.sort(2.0 * i + (1 - s))  # a node's scores from best to least
        first = np.searchsorted(i, np.arange(hi - lo + 1))
        full = np.flatnonzero(np.diff(first) > self.k)
        least[full] = np.maximum(least[full], 2 * full + 1 - ordered[first[full] + self.k])
        some = s >= least[i] - SLACK
        i, c, s = self.cut(i[some], nodes[j[some]], s[some])
        self.found.append((i + lo, c, s))
        self.size += len(i)
        if self.size > max(1 << 21, 4 * self.k * len(self.names)):
            self.best()

    def cut(self, i: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """In the order of node, score and name; of equal scores of a node the k + 1 least names."""
        order = np.lexsort((c, -s, i))
        i, c, s = i[order], c[order], s[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])
        place = np.arange(len(i))
        kept = place - np.maximum.accumulate(np.where(new, place, 0)) <= self.k
        return i[kept], c[kept], s[kept]

    def best(self) -> pa.RecordBatch:
        """What is left of all that was met."""
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        i, c, s = self.cut(*(np.concatenate(x) for x in zip(*none, *self.found, strict=True)))
        first = np.searchsorted(i, np.arange(len(self.names) + 1))
        full = np.flatnonzero(np.diff(first) > self.k)
        self.least[full] = np.maximum(self.least[full], s[first[full] + self.k])
        some = s >= self.least[i] - SLACK
        self.found, self.size = [(i[some], c[some], s[some])], int(some.sum())
        return pa.record_batch({"a": self.names[i[some]], "c": c[some], "s": s[some]})


def _blocks_of_rows(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (block, other, size, data) in the order of block, a block's own chunks first (other false): the best of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, rows = None, [], None

        def begun() -> _Rows:
            out = rows or _Rows(own, k)
            if rows is None:
                for chunk in own:
                    out.meet(chunk)
                own.clear()
            return out

        for b in batches:
            for block, other, size, data in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                if block != now and now is not None:
                    yield begun().best()
                    own, rows = [], None
                now = block
                chunk = pickle.loads(pa.decompress(data.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True))
                if other:
                    rows = begun()
                    rows.meet(chunk)
                else:
                    own.append(chunk)
        if now is not None:
            yield begun().best()

    return run


def recommendations(graph: Graph, k: int = 10, probe: int = 16) -> DataFrame:
    """(id, rank from 1, recommended, score): the k best nodes of each node by the cosine of their weighted neighbours, rounded to
    nine digits; equal scores by id. Nodes linked to it, itself and nodes that share no neighbour with it are none. Links count in both directions, weights of
    parallel ones add up, self-loops and links to unknown nodes don't count; a weight that is null, not above 0 or not finite is
    1. A node without links, and an empty graph, give no rows. Node ids must be distinct.

    Nodes of equal neighbours are computed once. Nodes are dealt to blocks of about ENTRIES entries, and a block's entries are CHUNKS
    rows of compressed numbers. A task holds one block and meets the chunks whose dimensions (neighbours) can be among its own one
    after the other, so no product is ever a row, and only each node's best leave the task. Nodes of
    over LONG entries meet all others in pairs of blocks of each dimension instead. The result is exact, and work is that of all
    two-step paths. `probe` is without effect: nothing is left out by bounds any more.
    """
    names, member, entries = _classes(graph)
    reps = member.where("id = cls").select("cls")
    own = entries.join(reps, entries["id"] == reps["cls"]).select("cls", F.col("other").alias("dim"), "w")
    norms = written(own.groupBy("cls").agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.count("*").alias("n"), F.avg("dim").alias("center")))
    blocks, count = _blocks(norms.where(F.col("n") <= LONG).select("cls", "n", "center"))
    rows = own.join(blocks, "cls").join(norms.select("cls", "sq"), "cls")
    shift = max(0, int(names.agg(F.max("number")).first()[0] or 0).bit_length() - RANGES)
    chunks = written(rows.groupBy("chunk").applyInArrow(_packed(shift), "block int, chunk long, size long, data binary, near array<long>"))
    near = chunks.select("block", "chunk", F.explode("near").alias("near"))
    meets = near.select("chunk", "near").join(near.select(F.col("block").alias("of"), "near").distinct(), "near").select("chunk", "of").distinct()
    sent = chunks.join(meets, "chunk").select(F.col("of").alias("block"), (F.col("block") != F.col("of")).alias("other"), "size", "data")
    sent = sent.repartitionById(max(1, count), "block").sortWithinPartitions("block", "other")
    best = sent.mapInArrow(_blocks_of_rows(k), "a long, c long, s double")
    long = written(norms.where(F.col("n") > LONG).select("cls", "sq"))
    if not long.isEmpty():
        asked = own.join(own.groupBy("dim").agg(F.count("*").alias("n")), "dim")
        given = asked.join(long.select("cls"), "cls")
        linked = own.join(long.select(F.col("cls").alias("dim")), "dim").select(F.col("cls").alias("a"), F.col("dim").alias("c"))
        dots = _wedges(asked, given).where("a <> c").join(linked, ["a", "c"], "left_anti")
        sq = lambda c: norms.select(F.col("cls").alias(c), F.col("sq").alias(f"sq_{c}"))
        pairs = written(dots.join(sq("a"), "a").join(sq("c"), "c").select("a", "c", (F.col("dot") / F.sqrt(F.col("sq_a") * F.col("sq_c"))).alias("s")))
        back = pairs.join(long.select(F.col("cls").alias("a")), "a", "left_anti")
        best = best.unionByName(pairs).unionByName(back.select(F.col("c").alias("a"), F.col("a").alias("c"), "s"))

    # k + 1 classes, and k + 1 members of each, hold the k best of every member; itself is one of those at most
    same = member.groupBy("cls").agg(F.count("*").alias("size")).where("size > 1")
    score = best.select("a", "c", F.round("s", 9).alias("score")).unionByName(same.select(F.col("cls").alias("a"), F.col("cls").alias("c"), F.lit(1.0).alias("score")))
    order = Window.partitionBy("a").orderBy(F.desc("score"), "c")
    top = score.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1).drop("__r")
    name = lambda number, to: names.select(F.col("number").alias(number), F.col("name").alias(to))
    heads = member.withColumn("__r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("__r") <= k + 1).select(F.col("cls").alias("c"), F.col("id").alias("recommended")).join(name("recommended", "name"), "recommended")
    ranked = Window.partitionBy("a").orderBy(F.desc("score"), "recommended")
    lists = top.join(heads, "c").withColumn("__r", F.row_number().over(ranked)).where(F.col("__r") <= k + 1)
    lists = lists.groupBy(F.col("a").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("__r", "recommended", "name", "score"))).alias("best"))
    mine = member.join(name("id", "__id"), "id").join(lists, "cls")  # names are joined before lists become rows
    mine = mine.select("__id", F.posexplode(F.slice(F.filter("best", lambda b: b["recommended"] != F.col("id")), 1, k)).alias("at", "b"))
    return mine.select(F.col("__id").alias("id"), (F.col("at") + 1).alias("rank"), F.col("b.name").alias("recommended"), "b.score")
