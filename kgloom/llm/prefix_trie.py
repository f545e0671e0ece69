"""Prefix trie of conversations, from sorted neighbours.

Conversations are sorted by their turns (128 bits of hash each) in ranges of equal size, so copies and common beginnings of any
number lie next to each other and are cut where ranges end. In a range, the edges between sorted neighbours, each as deep as
their longest common prefix, are taken in descending depth by union-find: a merge makes a branching node of that depth, or adds
to the one that is there. Nodes between two branching ones have the same members and are spelled out at the end.

A node whose conversations reach over a range's end is open: it lies on the path of the range's first or last conversation, no
deeper than what that shares with its neighbour. A range's forest is contracted to these nodes, with sums over everything
closed below them, and one sweep over the ranges in order merges them, holding one path at a time. All other nodes are
finished in their range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_or_joined, word_count

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations whose ids one open row carries; more are carried by further rows.
CHUNK = 1 << 16


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as structs of hashes and words (h1, h2, w). turns: conv_id, turn,
    role, text.

    Turns go by `turn`, null first, equal ones by hash. Null roles and texts are empty. Rows without a conv_id belong to no
    conversation. A conversation is one row of about 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("at"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), role, text).alias("h2"), word_count(text).alias("w"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "h1", "h2", "w"))).alias("x"))
    return c.select("conv_id", F.transform("x", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["w"].alias("w"))).alias("turns"))


def branched(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations as branches of others: the first h turns of each are those of conversation c - c % every (as many as it has,
    none if there is no such one), h being the CRC-32 of the decimal c modulo most."""
    c = F.col("conv_id")
    heads = convs.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    keyed = convs.select("conv_id", "turns", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).cast("int").alias("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.slice("head", F.lit(1), F.col("h"))
    return keyed.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(first, F.slice("turns", 1, 0)), own).alias("turns"))


class Range(NamedTuple):
    """The sorted conversations of a range, and down to which depth the path of the first and of the last one is open (-1: not)."""

    number: int
    conv: np.ndarray
    begin: np.ndarray  # of each conversation's turns, and the end of the last
    h1: np.ndarray
    h2: np.ndarray
    words: np.ndarray  # running totals, from 0
    left: int
    right: int

    def common(self) -> np.ndarray:
        """Longest common prefix of each conversation with the one before; 0 for the first."""
        size, out = np.diff(self.begin), np.zeros(len(self.conv), np.int64)
        live, d = np.arange(1, len(size)), 0
        while len(live):
            live = live[(size[live] > d) & (size[live - 1] > d)]
            a, b = self.begin[live] + d, self.begin[live - 1] + d
            live = live[(self.h1[a] == self.h1[b]) & (self.h2[a] == self.h2[b])]
            d += 1
            out[live] = d
        return out

    def words_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of a conversation's first turns."""
        return self.words[self.begin[row] + depth] - self.words[self.begin[row]]


class Forest:
    """The branching nodes and the ends of a range's conversations. What is open counts nowhere but in its own sums."""

    def __init__(self, r: Range) -> None:
        n = len(r.conv)
        self.r = r
        # count is 0 where a node was found to be a copy of another
        self.depth, self.first, self.count, self.low = np.diff(r.begin).tolist(), list(range(n)), [1] * n, r.conv.tolist()
        self.ends, self.kids, self.leaves, self.saved, self.up = [1] * n, [0] * n, [0] * n, [0] * n, [-1] * n
        common = r.common()
        root, node = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in (np.argsort(-common[1:], kind="stable") + 1).tolist():
            d, left, right = int(common[i]), find(i - 1), find(i)
            a, b = node[left], node[right]
            if self.depth[a] > d:
                a = self._branch(d, a)
            if self.depth[b] > d:
                self._attach(b, a)
            self.count[a] += self.count[b]
            self.low[a] = min(self.low[a], self.low[b])
            if self.depth[b] == d:  # a copy: no node of its own
                self.ends[a] += 1
                self.count[b] = 0
            root[right], node[left] = left, a
        top = node[find(n - 1)]
        self.top = top if self.depth[top] == 0 else self._branch(0, top)

    def _branch(self, d: int, child: int) -> int:
        for column, value in ((self.depth, d), (self.first, self.first[child]), (self.count, self.count[child]), (self.low, self.low[child]), (self.ends, 0), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.up, -1)):
            column.append(value)
        self._attach(child, len(self.depth) - 1)
        return len(self.depth) - 1

    def open_to(self, node: int) -> int:
        """Down to which depth the node and those above it are open."""
        left = self.r.left if self.first[node] == 0 else -1
        return max(left, self.r.right if self.first[node] + self.count[node] == len(self.r.conv) else -1)

    def _below(self, node: int, d: int) -> tuple[int, int]:
        """Leaves and saved words of the nodes deeper than d that lead to a closed node and of all below it."""
        r, first = self.r, self.first[node]
        words = int(r.words[r.begin[first] + self.depth[node]] - r.words[r.begin[first] + d])
        return self.leaves[node] or 1, self.saved[node] + (self.count[node] - 1) * words

    def _attach(self, child: int, parent: int) -> None:
        self.up[child] = parent
        if self.open_to(child) <= self.depth[parent]:
            leaves, saved = self._below(child, self.depth[parent])
            self.kids[parent] += 1
            self.leaves[parent] += leaves
            self.saved[parent] += saved

    def ids(self, node: int) -> Iterator[str]:
        """Decimal ids of the conversations that end at the node, comma-joined, in chunks."""
        first, last = self.first[node], self.first[node] + self.ends[node]
        for at in range(first, last, CHUNK):
            yield ",".join(map(str, self.r.conv[at : min(at + CHUNK, last)].tolist()))

    def open_rows(self) -> Iterator[tuple]:
        """OPEN rows: of each open node its sums over what is closed below it, then further chunks of ids."""
        r = self.r
        for c in np.flatnonzero(self.count).tolist():
            to = min(self.open_to(c), self.depth[c])
            for d in range(self.depth[self.up[c]] + 1 if self.up[c] >= 0 else 0, to + 1):
                on_left, on_right = self.first[c] == 0 and d <= r.left, self.first[c] + self.count[c] == len(r.conv) and d <= r.right
                kids = leaves = saved = 0
                chunks = iter(())
                if d == self.depth[c]:
                    kids, leaves, saved, chunks = self.kids[c], self.leaves[c], self.saved[c], self.ids(c)
                elif d == to:
                    kids, (leaves, saved) = 1, self._below(c, d)
                at = r.begin[self.first[c]] + d
                words = int(r.words[at] - r.words[at - 1]) if d else 0
                yield r.number, not on_left, d, 0, on_left and on_right, self.count[c], self.low[c], kids, leaves, saved, words, next(chunks, None)
                for k, chunk in enumerate(chunks):
                    yield r.number, not on_left, d, k + 1, on_left and on_right, 0, self.low[c], 0, 0, 0, 0, chunk

    def closed(self) -> dict[str, np.ndarray | list]:
        """Columns of NODE for the closed nodes."""
        r = self.r
        depth, first, count, low, up = (np.array(x, np.int64) for x in (self.depth, self.first, self.count, self.low, self.up))
        to = np.maximum(np.where(first == 0, r.left, -1), np.where(first + count == len(r.conv), r.right, -1))
        above = np.where(up >= 0, depth[up], -1)
        begin = np.maximum(to, above) + 1
        m = np.where(count > 0, np.maximum(depth - begin + 1, 0), 0)
        node = np.repeat(np.arange(len(depth)), m)
        d = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + begin[node]
        last, head = d == depth[node], d == begin[node]
        own = r.words_to(first[node], depth[node]) - r.words_to(first[node], np.maximum(d - 1, 0))
        digest = [hashlib.sha256(",".join(self.ids(c)).encode()).hexdigest() if end and self.ends[c] else None for c, end in zip(node.tolist(), last.tolist(), strict=True)]
        up_open = head & (d > 0) & (d - 1 <= np.maximum(to[node], np.where(up[node] >= 0, to[up[node]], -1)))
        parent = np.where(head, low[up[node]], low[node])
        on_left = (first[node] == 0) & (d - 1 <= r.left) | (up[node] >= 0) & (first[up[node]] == 0) & (d - 1 == above[node]) & (d - 1 <= r.left)
        return {
            "range": np.full(len(d), r.number, np.int32),
            "depth": d,
            "conv_id": low[node],
            "parent_conv_id": pa.array(parent, pa.int64(), mask=up_open | (d == 0)),
            "up_right": pa.array(~on_left, pa.bool_(), mask=~up_open),
            "n_convs": count[node],
            "n_children": np.where(last, np.array(self.kids)[node], 1),
            "n_leaves": np.maximum(np.array(self.leaves)[node], 1),
            "saved_tokens": np.array(self.saved)[node] + (count[node] - 1) * own,
            "ends_sha256": pa.array(digest, pa.string()),
        }


#: up_right: if the parent is open, whether it is known as one of the range's right path; else null, like the parent's id then.
NODE = "range int, depth long, conv_id long, parent_conv_id long, up_right boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: to_right: on the right path, not the left one; through: on both.
OPEN = "range int, to_right boolean, depth long, chunk int, through boolean, n_convs long, low long, kids long, leaves long, saved long, words long, ids string"
SWEPT = "node long, range int, to_right boolean, depth long, conv_id long, up long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*part, strict=True), strict=True)), schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*part, strict=True), strict=True)), schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _read(batches: Iterator[pa.RecordBatch], bounds: dict[int, tuple[int, int]]) -> Range | None:
    """One range as arrays; batches: conv_id, h1, h2, w, range."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return None
    t = pa.Table.from_batches(table).combine_chunks()
    column = lambda name: t.column(name).chunk(0)
    h1, begin, number = column("h1"), column("h1").offsets.to_numpy().astype(np.int64), column("range")[0].as_py()
    flat = lambda name: column(name).flatten().to_numpy()
    return Range(number, column("conv_id").to_numpy(), begin - begin[0], h1.flatten().to_numpy(), flat("h2"), np.append(0, np.cumsum(flat("w"))), *bounds[number])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """SWEPT rows from OPEN rows in order of range, side, depth and chunk: one that names the node for each range and side that
    knows it, and one with its figures once the last range has passed."""
    path: list[dict] = []
    made, now, through, pushed = 0, None, 0, True

    def close(to: int) -> Iterator[tuple]:
        while len(path) > to:
            x = path.pop()
            leaves, saved = x["leaves"] or 1, x["saved"] + (x["n"] - 1) * x["words"]
            if path:
                path[-1]["kids"] += 1
                path[-1]["leaves"] += leaves
                path[-1]["saved"] += saved
            yield x["node"], None, None, len(path), x["low"], path[-1]["node"] if path else None, x["n"], x["kids"], leaves, saved, x["ends"].hexdigest()

    for b in batches:
        for row in b.to_pylist():
            if row["range"] != now:
                if not pushed:
                    yield from close(through)
                now, through, pushed = row["range"], 0, False
            d = row["depth"]
            if row["to_right"] and not pushed:
                yield from close(through)
                pushed = True
            if row["to_right"] and not row["chunk"]:
                path.append({"node": made, "n": 0, "low": row["low"], "kids": 0, "leaves": 0, "saved": 0, "words": row["words"], "ends": hashlib.sha256(), "any": False})
                made += 1
            x = path[d]
            if not row["chunk"]:
                through += row["through"]
                x["n"], x["low"] = x["n"] + row["n_convs"], min(x["low"], row["low"])
                x["kids"], x["leaves"], x["saved"] = x["kids"] + row["kids"], x["leaves"] + row["leaves"], x["saved"] + row["saved"]
                yield x["node"], row["range"], row["to_right"], d, None, None, None, None, None, None, None
            if row["ids"] is not None:
                x["ends"].update(b"," * x["any"] + row["ids"].encode())
                x["any"] = True
    yield from close(0)


def _bounds(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each range, down to which depth its first and its last path are open: two numbers a range at the driver."""
    edges = ranged.groupBy("range").agg(F.min(F.struct("path", "conv_id"))["path"].alias("first"), F.max(F.struct("path", "conv_id"))["path"].alias("last"))
    schema = pa.schema([("range", pa.int32()), ("left", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            left = []
            for first, last in zip(b.column(1), b.column(2), strict=True):
                x, y = first.values.to_numpy(), before
                if y is not None:
                    m = min(len(x), len(y))
                    differ = np.flatnonzero(x[:m] != y[:m])
                left.append(-1 if y is None else int(differ[0] if len(differ) else m) // 2)
                before = last.values.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.int64())], schema=schema)

    found = sorted((r["range"], r["left"]) for r in edges.repartition(1).sortWithinPartitions("range").mapInArrow(run, "range int, left long").collect())
    return {n: (left, right) for (n, left), (_, right) in zip(found, [*found[1:], (None, -1)], strict=False)}


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations (conv_id, turns, as conversations() makes them), from
    the empty one at depth 0: conv_id (the smallest that begins so), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, the words of a node's last turn
    times its conversations but one), ends_sha256 (of the ascending, comma-joined ids of those that end there).

    (conv_id, depth) tells nodes apart. conv_ids are distinct and not null; conversations without turns end at the root.
    No conversation: no node. A task holds one range of conversations, 24 bytes a turn; the sweep's rows are the turns that
    conversations at the ends of neighbouring ranges share, and the ids that end at such nodes pass it in order, as a digest
    is made in order. The range cuts that Spark samples are paths, of 16 bytes a turn.
    """
    path = F.flatten(F.transform("turns", lambda t: F.array(t["h1"], t["h2"])))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["w"]).alias("w"))
    ranged = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranged = materialize(ranged.select("conv_id", "path", "w", F.spark_partition_id().alias("range")))
    bounds = _bounds(ranged)
    every = lambda odd: F.filter("path", lambda x, i: i % 2 == odd)
    arrays = ranged.select("conv_id", every(0).alias("h1"), every(1).alias("h2"), "w", "range")

    def run_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _read(batches, bounds)
        if r is not None and max(r.left, r.right) >= 0:
            yield from _batches(Forest(r).open_rows(), _schema(OPEN), 64)

    def run_closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _read(batches, bounds)
        if r is not None:
            b = pa.RecordBatch.from_pydict(Forest(r).closed(), _schema(NODE))
            yield from (b.slice(at, CHUNK) for at in range(0, b.num_rows, CHUNK))

    def run_sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_sweep(batches), _schema(SWEPT))

    order = ["range", "to_right", "depth", "chunk"]
    swept = materialize(arrays.mapInArrow(run_open, OPEN).repartition(1).sortWithinPartitions(*order).mapInArrow(run_sweep, SWEPT))
    done = swept.where("range is null")
    up = done.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    columns = ["conv_id", "depth", "parent_conv_id", *figures]
    merged = done.join(up, "up", "left").select(*columns)
    names = swept.where("range is not null").select("node", "range", F.col("to_right").alias("up_right"), (F.col("depth") + 1).alias("depth"))
    names = materialize(names.join(done.select("node", F.col("conv_id").alias("__up")), "node").drop("node"))
    closed = arrays.mapInArrow(run_closed, NODE).join(small_or_joined(names, 100_000), ["range", "up_right", "depth"], "left")
    closed = closed.select("conv_id", "depth", F.coalesce("parent_conv_id", "__up").alias("parent_conv_id"), *figures)
    return closed.unionByName(merged).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes of a trie over unchanged conversations, with role and text of each one's last turn (the root: null). turns: the
    table that the conversations were made of."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.xxhash64(role, text), F.xxhash64(F.lit(7), role, text))
    numbered = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.row_number().over(order).cast("long").alias("depth"), role.alias("role"), text.alias("text"))
    return nodes.join(numbered, ["conv_id", "depth"], "left")
