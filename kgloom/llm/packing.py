"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

Texts become token pieces; the plan is made on the histogram of piece lengths, at most `size` counts however many
pieces there are: for the longest length left, its gap is filled exactly by one available length, else by a pair, else
by a triple, as often as the counts allow; what fits nothing exactly is filled best-fit. Pieces then take their
places by rank within their length, ranks being counted in salted blocks so that a hot length is never one group.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts, sliced

#: Distinct words whose ids a worker remembers; beyond, the half that it met first stays, as frequent words come early.
CACHE = 1_000_000
#: Words longer than this are not remembered.
CACHE_WORD = 200


@cache
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, word by word. Its tokenizer never joins across white space (ids of a
    text are those of its words in turn)."""

    def __init__(self, path: str, remember: int = CACHE) -> None:
        self.tok, self.seen, self.remember = _tokenizer(path), {}, remember

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)]

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8").split()
        seen = self.seen
        try:
            return b"".join([seen[w] for w in words])
        except KeyError:
            new = list({w for w in words if w not in seen})
            if len(seen) + len(new) > self.remember:
                seen = self.seen = dict(islice(seen.items(), self.remember // 2))
                new = list({w for w in words if w not in seen})
            seen.update(zip(new, self._encode(new), strict=True))
            out = b"".join([seen[w] for w in words])
            for w in new:
                if len(w) > CACHE_WORD:
                    del seen[w]
            if len(seen) > self.remember:
                self.seen = dict(islice(seen.items(), self.remember // 2))
            return out


@cache
def word_ids(path: str, remember: int = CACHE) -> WordIds:
    """One for each worker process, so that its tasks share what is remembered."""
    return WordIds(path, remember)


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False, remember: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, 32-bit little-endian).

    A document is its ids and end_id; only longer ones are cut, into pieces of size and a last, shorter one. A null or
    empty text is end_id alone. Repeated rows are pieces of their own.
    """
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, remember)
        for b in sliced(batches):
            where, number, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = ids_of(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    where.append(row)
                    number.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            cols = [b.column(0).take(pa.array(where, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, {PIECE_SCHEMA}" + ", ids binary" * with_ids)


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence, in their order there) and how often each is used; counts[l]: pieces of
    length l, for l up to the size."""
    left, size, out = np.array(counts, np.int64), len(counts) - 1, []

    def use(pattern: list[int]) -> None:
        lengths, per = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // per).min())
        left[lengths] -= times * per
        out.append((pattern, times))

    def pair(total: int, ceiling: int) -> tuple[int, int] | None:
        """The pair a >= b of available lengths with a + b = total, a as large as can be."""
        a = np.arange(min(total - 1, ceiling), (total - 1) // 2, -1)
        if not len(a):
            return None
        good = (left[a] > 0) & (left[total - a] > 0) & ((a * 2 != total) | (left[a] > 1))
        at = int(good.argmax())
        return (int(a[at]), int(total - a[at])) if good[at] else None

    for top in range(size, 0, -1):
        while left[top]:
            gap = size - top
            left[top] -= 1  # itself, while its complements are sought
            if not gap:
                left[top] += 1
                use([top])
                continue
            found: list[int] | None = [gap] if left[gap] > 0 else None
            if not found and (two := pair(gap, top)):
                found = list(two)
            if not found:
                have = np.flatnonzero(left[1 : min(gap - 1, top + 1)])[::-1] + 1
                for a in have:
                    left[a] -= 1
                    two = pair(gap - int(a), int(a))
                    left[a] += 1
                    if two and (two[0] != a or left[a] > 2 - (two[1] != a)):
                        found = [int(a), *two]
                        break
            if not found:  # best-fit residual
                found, room = [], gap
                spare = left.copy()
                while room and len(fits := np.flatnonzero(spare[1 : room + 1])):
                    a = int(fits[-1]) + 1
                    found.append(a)
                    spare[a] -= 1
                    room -= a
            left[top] += 1
            use([top, *found])
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, block: int = 1 << 16, remember: int = CACHE) -> DataFrame:
    """pieces() with sequence_id and offset. Sequences hold at most size tokens and are gapless from 0.

    The driver gets the histogram of lengths (size numbers) and tasks get the plan (patterns; each uses up at least one
    length, so there are O(size) of them). Empty table: no rows. Ties in rank are broken by id, piece and crc.
    A worker remembers the ids of at most `remember` distinct words: memory against time, the result is the same.
    """
    p = pieces(docs, tokenizer, id_col, text_col, size, end_id, remember=remember)
    salts = max(1, 4 * parts(docs.sparkSession))
    p = materialize(p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    hist = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    hist = materialize(hist)
    counts = np.zeros(size + 1, np.int64)
    for r in hist.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    patterns = plan(counts)
    # the ranks of each length that a pattern's slot takes: (length, first rank) -> (first sequence, offset)
    slots, used, sequence = [], np.zeros(size + 1, np.int64), 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            slots.append((n, int(used[n]), sequence, at))
            used[n] += times
            at += n
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = hist.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("rn", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rn") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, n << 48 | rank, "right") - 1
            cols = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {id_type}, {PIECE_SCHEMA}, sequence_id long, offset long")
