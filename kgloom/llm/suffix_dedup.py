"""Exact removal of long repeated strings with sparse suffix arrays, built by deep-shallow sorting.

Everything covered by a string of `length` units that also starts anywhere else goes; units are bytes, or words (so that
white space between them doesn't matter). A suffix array of a whole corpus can't be shuffled, so only anchor suffixes are:
each window of `length` units picks its k-gram of least hash (leftmost of equal ones), a choice that depends on the
window's content alone, so equal windows have equal k-grams at equal places. An anchor stands for the run of windows that
picked it. Anchors are grouped by their k-gram:

* a k-gram seen once: none of its windows repeats;
* anchors whose whole stretches (all windows of the run) have equal hashes (64 bits within a k-gram's 64 bits): all their
  windows repeat, and one of them stands for the class from here on, so copies of any number are one row;
* classes of one k-gram are compared by a sparse suffix array: the texts right of the k-gram are sorted by multikey
  quicksort to a shallow depth and by blind tries below it, the texts left of it likewise (reversed), and merging the
  intervals of the right order by falling common prefix finds, for each anchor, the partner that shares most on the left.

A k-gram with more than `hot` classes is extended before it is compared: two anchors that share at least `length` units
share either the first half of what is needed on the right, or more than the other half on the left, so each anchor goes
to a group by either. Groups still too large are split again, at last by whole windows, where to meet is to be equal. So
no task gathers a large group, and work and memory follow the input at any skew.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import KeyBits, materialize

#: Classes of one group that one task may gather (about 600 bytes each); the result is the same for any number.
HOT = 2048
#: Units of a text that are hashed at once; positions within must fit in 24 bits.
SEGMENT = 1 << 20
SHALLOW = 16
_BASE = 0x9E3779B97F4A7C15 | 5
_MOD = 1 << 64


class Cut(NamedTuple):
    """What counts as a repeat: at least `length` units, which are "bytes" or "words"."""

    unit: str
    length: int

    @property
    def k(self) -> int:
        """Shorter k-grams make fewer anchors (one per (length - k) / 2 units) but more variants of each."""
        return max(1, self.length // 6)

    @property
    def least_bytes(self) -> int:
        return self.length if self.unit == "bytes" else 2 * self.length - 1


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_starts(buf: np.ndarray) -> np.ndarray:
    space = _SPACE[buf]
    return np.flatnonzero(~space & np.append(True, space[:-1])) if len(buf) else np.zeros(0, np.int64)


class Line:
    """A text as a sequence of units. data[at[i]:at[i + 1]] is unit i of words, each of which ends in one space, whatever
    white space follows it in the text."""

    def __init__(self, text: bytes, unit: str) -> None:
        self.data, self.at, self.size = text, None, len(text)
        if unit == "words":
            buf = np.frombuffer(text + b" ", np.uint8)
            space = _SPACE[buf]
            buf = np.where(space, np.uint8(32), buf)[~space | np.append(False, ~space[:-1])]
            self.data, self.at = buf.tobytes(), np.append(0, np.flatnonzero(buf == 32) + 1)
            self.size = len(self.at) - 1

    def edges(self, units: np.ndarray) -> list[int]:
        """Where units begin in data."""
        return (units if self.at is None else self.at[units]).tolist()

    def part(self, a: int, b: int) -> bytes:
        return self.data[a:b] if self.at is None else self.data[self.at[a] : self.at[b]]

    def back(self, a: int, b: int) -> bytes:
        """The units from b - 1 down to a."""
        return self.data[a:b][::-1] if self.at is None else b" ".join([*reversed(self.part(a, b).split()), b""])

    def values(self) -> np.ndarray:
        """A number for each unit, by which k-grams are picked; equal numbers of different words do no harm."""
        buf = np.frombuffer(self.data, np.uint8)
        if self.at is None:
            return _byte_values()[buf]
        (up, down), out, i = _powers(), np.zeros(self.size, np.uint64), 0
        while i < self.size:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + SEGMENT, "right")) - 1)
            begin, part = self.at[i], buf[self.at[i] : self.at[j]]
            if len(part) < len(up):
                prefix = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_byte_values()[part] * up[: len(part)], out=prefix[1:])
                at = self.at[i : j + 1] - begin
                h = (prefix[at[1:] - 1] - prefix[at[:-1]]) * down[at[:-1]]
                out[i:j] = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            else:  # one word longer than a segment
                out[i] = xxhash.xxh3_64_intdigest(part.tobytes())
            i = j
        return out


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + (1 << 16)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, _MOD), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _runs(values: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one segment: position, first and last window start of its run."""
    up, down = _powers()
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(_MOD - (1 << 24))
    h |= np.arange(n - k + 1, dtype=np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if width > span:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    at = (h & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], len(at)) - 1


def anchors_of(line: Line, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, first window and last window of each anchor."""
    if line.size < cut.length:
        return (np.zeros(0, np.int64),) * 3
    values = line.values()
    found = [_runs(values[base : base + SEGMENT + cut.length - 1], cut.length, cut.k) for base in range(0, line.size - cut.length + 1, SEGMENT)]
    return tuple(np.concatenate([f[i] + n * SEGMENT for n, f in enumerate(found)]) for i in range(3))


def _digests(line: Line, begin: np.ndarray, end: np.ndarray, seeds: list[int] | int) -> list[int]:
    digest, data, pairs = xxhash.xxh3_64_intdigest, line.data, zip(line.edges(begin), line.edges(end), strict=True)
    if isinstance(seeds, int):
        return [digest(data[x:y], seeds) for x, y in pairs]
    return [digest(data[x:y], s) for (x, y), s in zip(pairs, seeds, strict=True)]


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _blind_trie(s: list[bytes], which: list[int]) -> list[int]:
    """Sorts suffixes with long common prefixes: a trie that keeps only the depth and byte of each branch. An insertion
    walks by branch bytes to some leaf, compares with that leaf once, and splits the path at the common prefix."""
    def byte(x: int, d: int) -> int:
        return s[x][d] if d < len(s[x]) else -1

    root: list = [[which[0]]]  # a leaf is [equal suffixes]; a branch is [depth, children by byte]
    for x in which[1:]:
        node, path = root, []
        while len(node) == 2:
            path.append(node)
            node = node[1].get(byte(x, node[0])) or next(iter(node[1].values()))
        leaf, d = node[0][0], _lcp(s[x], s[node[0][0]])
        if d == len(s[x]) == len(s[leaf]):
            node[0].append(x)
            continue
        above = None
        node = root
        while len(node) == 2 and node[0] < d:
            above, node = node, node[1][byte(leaf, node[0])]
        if len(node) == 2 and node[0] == d:
            node[1][byte(x, d)] = [[x]]
            continue
        new = [d, {byte(leaf, d): node, byte(x, d): [[x]]}]
        if above is None:
            root = new
        else:
            above[1][byte(leaf, above[0])] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 1:
            out += node[0]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_sort(s: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort by four bytes at a time to the shallow depth, then blind tries."""
    out, stack = [], [(list(range(len(s))), 0)]
    while stack:
        part, d = stack.pop()
        if len(part) < 2:
            out += part
        elif d >= shallow:
            out += _blind_trie(s, part)
        else:
            keys = [s[x][d : d + 4] for x in part]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            same = [x for x, y in zip(part, keys, strict=True) if y == pivot]
            more = [x for x, y in zip(part, keys, strict=True) if y > pivot]
            less = [x for x, y in zip(part, keys, strict=True) if y < pivot]
            stack.append((more, d))
            stack.append((same, d + 4 if len(pivot) == 4 else shallow))
            stack.append((less, d))
    return out


def shared_ranges(left: list[bytes], right: list[bytes], need: int, unit: str = "bytes") -> list[list[tuple[int, int]]]:
    """For each anchor of one k-gram the ranges of x (units taken left of the k-gram) for which the x units on its left
    and the need-x units on its right are found at some other anchor too. left is reversed: nearest unit first."""
    def common(a: bytes, b: bytes) -> int:
        n = _lcp(a, b)
        return n if unit == "bytes" else a.count(b" ", 0, n)

    found: list[list[tuple[int, int]]] = [[] for _ in left]
    rank = [0] * len(left)
    by_left = deep_shallow_sort(left)
    for r, x in enumerate(by_left):
        rank[x] = r
    order = deep_shallow_sort(right)
    steps = sorted(((common(right[a], right[b]), i) for i, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    root, sets = list(range(len(order))), [[rank[x]] for x in order]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for shared, i in steps:
        a, b = find(i), find(i + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, small = sets[a], sets[b]
        for r in small:
            at = bisect_left(big, r)
            for q in big[max(0, at - 1) : at + 1]:
                x, y = by_left[r], by_left[q]
                both = common(left[x], left[y])
                if both + shared >= need:
                    span = (need - shared, both)
                    found[x].append(span)
                    found[y].append(span)
        for r in small:
            insort(big, r)
        sets[b], root[b] = [], a
    return found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((b, e))
    return out


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    xy = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(xy[:, i]) for i in range(len(names))], names)


_SIDES = pa.schema([(c, pa.binary() if c in ("left", "right") else pa.int64()) for c in ("core", "g", "lo", "hi", "variants", "id", "th", "cut", "at", "c", "left", "right")])
_SIDES_DDL = ", ".join(f"{f.name} {'binary' if f.name in ('left', 'right') else 'long'}" for f in _SIDES)
_SPANS = ["id", "th", "cut", "begin", "end"]
_SPANS_DDL = ", ".join(f"{c} long" for c in _SPANS)


def repeated_spans(docs: DataFrame, cuts: tuple[Cut, ...], hot: int = HOT) -> DataFrame:
    """(id, th, span) of repeated stretches, overlapping ones included: span has cut, begin and end in units of cuts[cut], or
    is null for an anchor that doesn't repeat as a whole. docs: id, th and text (bytes), read three times."""
    if any(c.length >= 1 << 16 for c in cuts):
        raise ValueError("length must be below 65536")

    def anchors(b: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, b.num_rows, 1024):
            for d, h, text in zip(*(b.column(i).slice(at, 1024).to_pylist() for i in range(3)), strict=True):
                for n, cut in enumerate(cuts):
                    line = Line(text, cut.unit)
                    yield d, h, n, cut, line, anchors_of(line, cut)

    def core_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores = [_digests(line, m, m + cut.k, n) for _, _, n, cut, line, (m, _, _) in anchors(b)]
            yield pa.RecordBatch.from_arrays([_signed([c for cs in cores for c in cs])], ["core"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cores, es = [np.zeros((0, 4), np.int64)], [], []
            for d, h, n, cut, line, (m, lo, hi) in anchors(b):
                rows.append(np.stack([np.full(len(m), d), np.full(len(m), h), np.full(len(m), n), m << 32 | (m - lo) << 16 | hi - lo], 1))
                cores += _digests(line, m, m + cut.k, n)
                es += _digests(line, lo, hi + cut.length, (m - lo).tolist())
            xy = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(xy[:, i]) for i in range(4)), _signed(cores), _signed(es)], ["id", "th", "cut", "pos", "core", "e"])

    long_enough = docs.where(F.octet_length("text") >= min(c.least_bytes for c in cuts)).select("id", "th", "text")
    cores = long_enough.mapInArrow(core_only, "core long").groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    cores = materialize(cores.select("core"))  # apart from the join, which can then split a hot k-gram
    anchors_all = long_enough.mapInArrow(find, "id long, th long, cut long, pos long, core long, e long")
    again = materialize(anchors_all.join(cores, "core"))
    m, lo = F.shiftright("pos", 32), F.shiftright("pos", 32) - F.shiftright("pos", 16).bitwiseAND(F.lit(0xFFFF))
    length = F.element_at(F.array(*[F.lit(c.length) for c in cuts]), (F.col("cut") + 1).cast("int"))
    whole = F.struct("cut", lo.alias("begin"), (lo + F.col("pos").bitwiseAND(F.lit(0xFFFF)) + length).alias("end"))
    classes = materialize(again.groupBy("core", "e").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "cut", "pos")).alias("rep")))
    sure = again.join(classes.select("core", "e", "c"), ["core", "e"]).select("id", "th", F.when(F.col("c") > 1, whole).alias("span"))
    sizes = materialize(classes.groupBy("core").agg(F.count("*").alias("variants")).where("variants > 1"))
    places = classes.join(sizes, "core").select("rep.id", "rep.th", F.struct("core", "rep.cut", "rep.pos", "c", "variants").alias("x"))
    places = materialize(places.groupBy("id", "th").agg(F.collect_list("x").alias("xs")))  # a document's own anchors

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                rows = []
                for d, h, text, xs in zip(*(b.column(i).slice(start, 256).to_pylist() for i in range(4)), strict=True):
                    lines = {n: Line(text, cuts[n].unit) for n in {x["cut"] for x in xs}}
                    for x in xs:
                        p, cut, line = x["pos"], cuts[x["cut"]], lines[x["cut"]]
                        at, first = p >> 32, (p >> 32) - (p >> 16 & 0xFFFF)
                        last = first + (p & 0xFFFF)
                        rows.append({"core": x["core"], "g": 0, "lo": 0, "hi": cut.length - cut.k, "variants": x["variants"], "id": d, "th": h, "cut": x["cut"], "at": at, "c": x["c"], "left": line.back(first, at), "right": line.part(at + cut.k, last + cut.length)})
                yield pa.RecordBatch.from_pylist(rows, _SIDES)

    asked = KeyBits(places, ["id", "th"]).rows(docs, True).join(places.hint("shuffle_hash"), ["id", "th"])
    sides = asked.select("id", "th", "text", "xs").mapInArrow(cut_out, _SIDES_DDL)
    found = [sure]
    if not sizes.where(F.col("variants") > hot).isEmpty():
        sides, met = _extended(materialize(sides), cuts, hot)
        found.append(met.select("id", "th", F.struct(*_SPANS[2:]).alias("span")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(group: list[tuple]) -> list[tuple]:
            n, out = group[0][2], []
            cut = cuts[n]
            shared = shared_ranges([g[5] for g in group], [g[6] for g in group], cut.length - cut.k, cut.unit)
            for (d, h, _, at, c, _, _), ranges in zip(group, shared, strict=True):
                if c == 1:
                    out += [(d, h, n, b, e) for b, e in merge([(at - x1, at - x0 + cut.length) for x0, x1 in ranges])]
            return out

        last, group = None, []
        for b in batches:
            out = []
            for core, g, *row in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (core, g) != last:
                    if len(group) > 1:
                        out += spans(group)
                    last, group = (core, g), []
                group.append(tuple(row))
            yield _table(out, _SPANS)
        if len(group) > 1:
            yield _table(spans(group), _SPANS)

    grouped = sides.select("core", "g", "id", "th", "cut", "at", "c", "left", "right").repartition("core", "g").sortWithinPartitions("core", "g")
    found.append(grouped.mapInArrow(compare, _SPANS_DDL).select("id", "th", F.struct(*_SPANS[2:]).alias("span")))
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0].unionByName(found[1]).unionByName(found[2])


def _extended(sides: DataFrame, cuts: tuple[Cut, ...], hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows of sides in groups (core, g) of at most hot, and spans of anchors that met in a group of one whole window.

    A row is of a group for pairs that share from lo to hi units on the right, and so at least need - hi on the left.
    Halving that range gives two groups whose members share more; pairs of the group are in one of them or in both."""
    def head(s: bytes, n: int, unit: str) -> bytes | None:
        """The first n units, None if there are fewer."""
        if unit == "bytes":
            return s[:n] if len(s) >= n else None
        return b" ".join([*s.split(b" ", n)[:n], b""]) if s.count(b" ") >= n else None

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = []
                for r in b.slice(at, 1024).to_pylist():
                    cut, mid = cuts[r["cut"]], (r["lo"] + r["hi"]) // 2
                    for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                        x, y = head(r["right"], lo, cut.unit), head(r["left"], cut.length - cut.k - hi, cut.unit)
                        if x is not None and y is not None:
                            g = xxhash.xxh3_64_intdigest(x + bytes([lo & 255, lo >> 8, hi & 255, hi >> 8]) + y)
                            rows.append(r | {"g": g - (1 << 63), "lo": lo, "hi": hi})
                yield pa.RecordBatch.from_pylist(rows, _SIDES)

    ready, met = [sides.where(F.col("variants") <= hot)], []
    todo = sides.where(F.col("variants") > hot)
    while not todo.isEmpty():
        parts = materialize(todo.mapInArrow(halve, _SIDES_DDL))
        sizes = parts.groupBy("core", "g").agg(F.count("*").alias("variants")).where("variants > 1")
        parts = materialize(parts.drop("variants").join(materialize(sizes), ["core", "g"]).select(*_SIDES.names))
        begin = F.col("at") - F.element_at(F.array(*[F.lit(c.length - c.k) for c in cuts]), (F.col("cut") + 1).cast("int")) + F.col("lo")
        length = F.element_at(F.array(*[F.lit(c.length) for c in cuts]), (F.col("cut") + 1).cast("int"))
        met.append(parts.where("lo = hi and c = 1").select("id", "th", "cut", begin.alias("begin"), (begin + length).alias("end")))
        ready.append(parts.where((F.col("variants") <= hot) & F.expr("lo < hi")))
        todo = parts.where((F.col("variants") > hot) & F.expr("lo < hi"))
    for some in (ready, met):
        while len(some) > 1:
            some.append(some.pop().unionByName(some.pop()))
    return ready[0], met[0]


def _byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of word spans: from the first word to the next one after the last, or the text's end."""
    at = np.append(word_starts(np.frombuffer(text, np.uint8)), len(text)).tolist()
    return [(at[b], at[e]) for b, e in spans]


def suffix_dedup(docs: DataFrame, cuts: tuple[Cut, ...] = (Cut("bytes", 400),), id_col: str = "doc_id", text_col: str = "text", out: str = "repeats", hot: int = HOT) -> DataFrame:
    """The columns of docs and `out`, a struct that has for each cut, under the name of its unit, n_removed (bytes),
    n_spans, spans (half-open byte ranges) and kept (the bytes left). A cut by words also takes the white space that
    follows its words, and leaves whole characters.

    A null text is empty. Rows with equal id and text are separate documents, so each repeats the other. Shorter texts
    lose nothing. Strings are judged on the input, not on what is left, and each cut on its own. A column of docs that is
    named like `out` is replaced; other names can't clash. Empty table: no rows. docs is read five times.
    """
    if len({c.unit for c in cuts}) != len(cuts):
        raise ValueError("one cut for each unit")
    names = [c for c in docs.columns if c != out]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    data = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.cast("binary").alias("text"))
    spans = repeated_spans(data.select("id", "th", "text"), cuts, hot)
    per_doc = spans.groupBy("id", "th").agg(F.collect_set("span").alias("spans"))  # within a document, nulls apart
    per_doc = materialize(per_doc.where(F.size("spans") > 0))
    bits, data = KeyBits(per_doc, ["id", "th"]), data.drop("text")
    some = bits.rows(data, True).join(per_doc.hint("shuffle_hash"), ["id", "th"], "left").select("row", "spans")
    none = data.select("row", bits.place.alias("place"))
    one = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("spans", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))), StructField("kept", BinaryType())])
    arrow_one = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    arrow_all = pa.struct([(c.unit, arrow_one) for c in cuts])

    def judged(text: bytes, cut: Cut, spans: list[tuple[int, int]]) -> dict:
        gone = merge(spans)
        if cut.unit == "words":
            gone = _byte_spans(text, gone) if gone else []
        ends = [0, *(e for _, e in gone)]
        kept = b"".join(text[x:y] for x, y in zip(ends, [*(s for s, _ in gone), len(text)], strict=True))
        return {"n_removed": len(text) - len(kept), "n_spans": len(gone), "spans": [{"begin": x, "end": y} for x, y in gone], "kept": kept}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, rows = b.slice(at, 1024), []
                spans = part.column(1).to_pylist() if part.schema.names[1] == "spans" else None
                part = part if spans is not None else bits.keep(part, 1, False)
                texts = part.column(0).flatten()[part.column(0).type.get_field_index(text_col)].cast(pa.binary()).to_pylist()
                for text, x in zip(texts, spans or [None] * len(texts), strict=True):
                    rows.append({c.unit: judged(text or b"", c, [(y["begin"], y["end"]) for y in x or () if y["cut"] == n]) for n, c in enumerate(cuts)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, arrow_all)], ["row", "cuts"])

    schema = StructType([StructField("row", data.schema["row"].dataType), StructField("cuts", StructType([StructField(c.unit, one) for c in cuts]))])
    return some.mapInArrow(cut, schema).unionByName(none.mapInArrow(cut, schema)).select("row.*", F.col("cuts").alias(out))
