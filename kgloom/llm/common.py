"""Helpers shared by the training-data operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import components, materialize

__all__ = ["KeyBits", "ROW_KEY", "Ranges", "WORD", "components", "first_rows", "materialize", "parts", "read_table", "row_key", "sliced", "small_or_joined", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows whose texts a Python worker holds as strings at once.
TEXTS = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows: Spark's of 10,000 hold their texts as Arrow has them, but only a slice's become strings,
    and results of a slice go before the next one's are made."""
    for b in batches:
        for at in range(0, b.num_rows, rows or TEXTS):
            yield b.slice(at, rows or TEXTS)


def word_count(text: Column) -> Column:
    """Number of words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


ROW_KEY = ["__n", "__id", "__th"]


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """Columns that tell rows apart by id (null after all others) and hash of the text, and are never null."""
    i = F.col(f"`{id_col}`").cast("long")
    return {"__n": i.isNull(), "__id": F.coalesce(i, F.lit(0).cast("long")), "__th": F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))}


def first_rows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay: of each group (ROW_KEY, component) the one of smallest id (nulls last; then of least text
    hash), one of them if the whole row's id and text are repeated. Texts are shuffled once, by row."""
    first = groups.groupBy("component").agg(F.min(F.struct(*ROW_KEY)).alias("x")).select("x.*")
    return docs.withColumns(row_key(id_col, text_col)).join(first, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).select(*[F.col(f"`{c}`") for c in docs.columns])


def small_or_joined(df: DataFrame, rows: int) -> DataFrame:
    """A materialized side of a join: broadcast if it has at most so many rows (of a few KB), else joined like any other."""
    return F.broadcast(df) if df.count() <= rows else df


class KeyBits:
    """A Bloom bitmap of the keys of a materialized table, of eight bits or more a key up to 8 MB in all, so that rows with
    other keys need not be shuffled into a join with it. Rows that pass may still have no key there."""

    def __init__(self, keys: DataFrame, columns: list[str], most: int = 1 << 26) -> None:
        n = 1 << 15
        while n < min(8 * keys.count(), most):
            n *= 2
        self.place = F.pmod(F.xxhash64(*columns), F.lit(n))
        bits = keys.select(self.place.alias("p")).groupBy(F.shiftright("p", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
        whole = np.zeros((n >> 15, 1 << 12), np.uint8)
        for r in bits.collect():  # at most `most` bits
            whole[r["b"]] = np.frombuffer(r["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(whole.ravel())

    def keep(self, b: pa.RecordBatch, at: int, present: bool) -> pa.RecordBatch:
        """Rows whose place (column number `at`) is marked, or those whose place is not. Runs in tasks."""
        bits, p = self.shared.value, b.column(at).to_numpy()
        return b.filter(pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == present))

    def rows(self, df: DataFrame, present: bool) -> DataFrame:
        """Rows whose key is marked, or those whose key is not."""
        bits = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield bits.keep(b, b.num_columns - 1, present).select(range(b.num_columns - 1))

        return df.select("*", self.place.alias("__place")).mapInArrow(run, df.schema)

    def __getstate__(self) -> dict:
        return {"shared": self.shared}


class Ranges:
    """Ranges of a string key that cut a table's rows into parts of about equal numbers, with each range's least and
    greatest key: at most `most` keys of each kind in tasks. The cuts are every fourth of the keys of least hash, so they
    follow where the keys are. Rows of one key stay together."""

    def __init__(self, df: DataFrame, key: Column, n: int, most: int = 1 << 13) -> None:
        keys = df.select(key.alias("k")).where("k is not null")
        cuts = keys.distinct().orderBy(F.xxhash64("k"), "k").limit(4 * min(n, most)).collect()
        self.cuts = sorted(r["k"] for r in cuts)[::4]
        found = materialize(self.numbered(keys, "k").groupBy("range").agg(F.min("k").alias("low"), F.max("k").alias("high"))).collect()
        found.sort(key=lambda r: r["range"])
        self.low, self.high = {r["range"]: r["low"] for r in found}, {r["range"]: r["high"] for r in found}
        order = [r["range"] for r in found]
        self.before, self.after = dict(zip(order[1:], order, strict=False)), dict(zip(order, order[1:], strict=False))

    def range_of(self, key: str) -> int:
        return bisect_left(self.cuts, key)

    def places(self, key: str) -> list[tuple[int, bool]]:
        """(range, whether it is the key's own): also the neighbouring ranges of which it is an edge row's key."""
        r = self.range_of(key)
        out = [(r, True)]
        if r in self.before and key == self.low[r]:
            out.append((self.before[r], False))
        if r in self.after and key == self.high[r]:
            out.append((self.after[r], False))
        return out

    def numbered(self, df: DataFrame, key: str) -> DataFrame:
        cuts = self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index(key)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_left(cuts, k) for k in b.column(at).to_pylist()], pa.int32())], [*b.schema.names, "range"])

        return df.mapInArrow(run, _with(df, "range int"))


def _with(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])
