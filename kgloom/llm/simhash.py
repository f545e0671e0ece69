"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of a text's word shingles. A covering family of 2^(r+1)-1 bit
masks guarantees that two fingerprints within Hamming radius r agree on all bits of some mask, so no linked pair is
ever missed: every bit position gets a non-zero vector of r+1 bits, mask v holds the positions whose vector has an odd
inner product with v, and r differing positions span at most r dimensions, so some v is orthogonal to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, components, first_rows, materialize, row_key

BITS = 64
#: Buckets with more distinct fingerprints are dealt to tasks as pairs of chunks of this many.
CHUNK = 4096


def fingerprint_of(text: str | None, shingle: int) -> int:
    return int(_fingerprints([text], shingle)[0])


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray | None:
    """XXH64 (seed 42) of each word shingle of a text, of all its words if they are fewer; None for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower folds A-Z only, bytes.split cuts at 09-0D and 20
    if not words:
        return None
    digest = xxhash.xxh64_intdigest
    n, joined = max(1, len(words) - shingle + 1), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin, end = [0, *ends[: n - 1].tolist()], [*(ends[shingle - 1 :] - 1).tolist()] or [len(joined)]
    return np.fromiter((digest(joined[b:e], 42) for b, e in zip(begin, end, strict=True)), np.uint64, n)


def fingerprint_bits(h: np.ndarray) -> np.uint64:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the bit matrix of a very long text
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">u8")[0]


def _fingerprints(texts: list, shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text, shingle)
        if h is not None:
            out[i] = fingerprint_bits(h)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """ROW_KEY and fp: one row per input row; null and empty texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_fingerprints(b.column(3).to_pylist(), shingle).view(np.int64))], [*ROW_KEY, "fp"])

    key = [c.alias(n) for n, c in row_key(id_col, text_col).items()]
    return docs.select(*key, F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "__n boolean, __id long, __th long, fp long")


def masks(radius: int) -> list[int]:
    """The covering family: 2^(radius+1)-1 masks over 64 bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, chunk: np.ndarray, pair: tuple[int, int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within radius among distinct fingerprints of one bucket: at most one edge fewer than
    there are fingerprints. Of a pair of two chunks only links across them are looked at; other tasks see the rest."""
    a = fps if pair[0] == pair[1] else fps[chunk == pair[0]]
    b = fps if pair[0] == pair[1] else fps[chunk == pair[1]]
    root = list(range(len(a) + (0 if a is b else len(b))))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found, shift = [], 0 if a is b else len(a)
    for i in range(0, len(a), 256):
        near = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius
        for x, y in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
            x += i
            if a is b and x >= y:
                continue
            p, q = find(x), find(y + shift)
            if p != q:
                root[q] = p
                found.append((int(a[x]), int(b[y])))
    return found


def near_edges(fps: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges whose connected components are those of all pairs of distinct fingerprints within the radius."""
    table = [_signed(m) for m in masks(radius)]
    banded = fps.select("fp", F.posexplode(F.array(*[F.lit(m).bitwiseAND(F.col("fp")) for m in table])).alias("mask", "key"))
    counts = banded.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = banded.join(counts, ["mask", "key"]).withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("mask", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    keys = ["mask", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: tuple, part: list[np.ndarray]) -> list[tuple[int, int]]:
            rows = np.concatenate(part)
            return _forest(rows[:, 1].view(np.uint64), rows[:, 0], (k[2], k[3]), radius)

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            xy = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["a", "b"])

        last, part = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            rows = np.stack([b.column(4).to_numpy().astype(np.int64), b.column(5).to_numpy()], 1)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            found = []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                k = tuple(int(c[x]) for c in cols)
                if k != last:
                    if part:
                        found += out(last, part)
                    last, part = k, []
                part.append(rows[x:y])
            yield batch(found)
        if part:
            yield batch(out(last, part))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, chunk: int) -> DataFrame:
    """ROW_KEY, fp and component (which names a group) per row."""
    fp = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(fp.select("fp").distinct())
    edges = near_edges(distinct, radius, chunk)
    comp = materialize(components(distinct.select(F.col("fp").alias("id")), edges))
    return fp.join(comp.select(F.col("id").alias("fp"), "component"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id, fp (signed 64 bits), component_id (the smallest id reachable over links).

    Copies share a fingerprint, so only distinct fingerprints enter the search: a group of copies of any size is one
    row there. Repeated ids keep their rows; null ids come after all others, and a group of them alone has a null
    component_id. Other columns are ignored. Empty table: no rows.
    """
    g = _groups(docs, id_col, text_col, shingle, radius, chunk).select(F.when(~F.col("__n"), F.col("__id")).alias("id"), "fp", "component")
    g = materialize(g)
    least = g.groupBy("component").agg(F.min("id").alias("component_id"))
    return g.join(materialize(least), "component").select("id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """The rows of docs that first_rows() keeps of groups of near SimHashes."""
    return first_rows(docs, _groups(docs, id_col, text_col, shingle, radius, CHUNK), id_col, text_col)
