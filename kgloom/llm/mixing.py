"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target comes from its weight, capped at max_copies times its size (the excess is reshared by weight:
water-filling). Equal-token blocks are allocated to sources by highest quotients target / (2 blocks + 1), a source's
blocks to its shards likewise by their sizes, and each shard takes that many words: whole passes first, then blocks chosen by a
seeded permutation of its token line. Documents lie on the line in seeded order. Blocks are as long for all sources, and short
enough for the smallest one to have sixteen of them or blocks of one word; where a source is larger, its shards are cut at
longer blocks, up to `block` words, that the allocated ones are counted out in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_or_joined, word_count

WEIGHTS = (5, 2, 1)
#: Multipliers of the block permutation: primes above any shard's number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Sources of a mix: their rows (about 40 bytes each) meet in one task, as highest quotients compare all of them.
MAX_SOURCES = 5_000_000


def water_fill(weights: np.ndarray, caps: np.ndarray, budget: float) -> np.ndarray:
    """Shares of the budget by weight, none above its cap; what a cap cuts off goes to the others by weight."""
    ratio = np.where(weights > 0, caps / np.maximum(weights, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    out, rest, w = np.zeros(len(caps)), float(budget), float(weights.sum())
    for i in order:
        out[i] = min(float(caps[i]), rest * float(weights[i]) / w if w > 0 else 0.0)
        rest, w = rest - out[i], w - float(weights[i])
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats of each party by highest quotients votes / (2 seats + 1), none above its cap; equal quotients go to the
    first. A divisor is bisected for and the last seats are then given one by one, so the work doesn't follow seats."""
    votes = np.asarray(votes, float)
    caps = np.full(len(votes), seats, np.int64) if caps is None else np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum())) if len(votes) else 0
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.where(votes > 0, np.ceil(votes / divisor - 0.5), 0), caps).astype(np.int64)

    lo, hi = votes[votes > 0].min() / (4.0 * seats + 4), 4 * votes.sum() + 1  # at(lo) gives enough, at(hi) nothing or little
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if at(mid).sum() <= seats:
            hi = mid
        else:
            lo = mid
        if hi / lo < 1 + 1e-12:
            break
    got = at(hi)
    while got.sum() < seats:
        quotient = np.where((got < caps) & (votes > 0), votes / (2 * got + 1), -1.0)
        got[int(quotient.argmax())] += 1
    return got


def targets(sizes: DataFrame, share: float, max_copies: int, block: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size. Adds target, quota (words), block (words of the source's own blocks) and unit (words of the
    allocated ones). One row per source meets in one task, no documents; more
    than MAX_SOURCES of them are an error."""
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["source"].map(lambda x: (x is None or x != x, "" if x is None or x != x else x))
        pdf = pdf.loc[key.sort_values(key=lambda s: s).index]
        size = pdf["source_size"].to_numpy(np.float64)
        w = np.resize(np.array(weights, float), len(pdf))
        t = water_fill(w, max_copies * size, share * size.sum())
        own = _own_block(size, block)
        unit = int(own[size > 0].min()) if (size > 0).any() else 1
        quota = unit * sainte_lague(t, round(t.sum() / unit))
        return pdf[["source", "source_size"]].assign(target=t, quota=quota, block=own, unit=unit)

    return sizes.groupBy().applyInPandas(run, "source string, source_size long, target double, quota long, block long, unit long")


def _own_block(size: np.ndarray, block: int) -> np.ndarray:
    """Words of a source's blocks: the greatest power of two up to block of which the source has sixteen, or one."""
    most = np.minimum(np.maximum(size // 16, 1), block)
    return 1 << np.floor(np.log2(most)).astype(np.int64)


def _shard_quotas(shards: DataFrame, max_copies: int) -> DataFrame:
    """shards: source, shard, shard_size, quota (words), block and unit of the source. Returns source, shard, n_blocks, passes (over
    the whole shard) and rest (blocks of one more)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        size, block, unit = pdf["shard_size"].to_numpy(np.int64), int(pdf["block"].iloc[0]), int(pdf["unit"].iloc[0])
        words = unit * sainte_lague(size.astype(np.float64), int(pdf["quota"].iloc[0]) // unit, -(-max_copies * size // unit))
        n = -(-size // block)
        passes = np.minimum(words // np.maximum(size, 1), max_copies)
        rest = np.where(passes < max_copies, np.minimum((words - passes * size + block // 2) // block, n), 0)
        whole = (rest == n) & (n > 0)
        return pdf[["source", "shard"]].assign(n_blocks=n, passes=passes + whole, rest=np.where(whole, 0, rest))

    return shards.groupBy("source").applyInPandas(run, "source string, shard int, n_blocks long, passes long, rest long")


def taken_in_blocks(first: Column, size: Column, n_blocks: Column, rest: Column, seed: Column, block: int | Column) -> Column:
    """Words of [first, first + size) of a shard's line that lie in the chosen blocks."""
    one = F.lit(block) if isinstance(block, int) else block

    def chosen(j: Column) -> Column:
        return position(j, n_blocks, seed) < rest

    def step(acc: Column, j: Column) -> Column:
        inside = F.least(first + size, (j + 1) * one) - F.greatest(first, j * one)
        return acc + F.when(chosen(j), inside).otherwise(F.lit(0)).cast("long")

    span = F.sequence(F.floor(first / one), F.floor((first + size - 1) / one))
    return F.when((size > 0) & (rest > 0), F.aggregate(span, F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def position(j: Column, n_blocks: Column, seed: Column) -> Column:
    """Place of block j in the shard's seeded permutation of its blocks."""
    a = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(seed, F.lit(len(PRIMES))) + 1).cast("int")) % n_blocks
    return F.pmod(j * a + F.pmod(seed, n_blocks), n_blocks)


def _source_key(source: Column) -> Column:
    """A key that is never null, so that rows without a source join like others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _source_name(key: str) -> Column:
    return F.when(F.col(key) != "", F.substr(F.col(key), F.lit(2)))


def _placed(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, share: float, max_copies: int, block: int, shard_words: int, seed: int) -> DataFrame:
    """The kept columns of docs, and __-columns: what each row takes and from where on its shard's line. Texts that are not
    kept are read once."""
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], _source_key(F.col(f"`{source_col}`")).alias("__source"), word_count(text).alias("__size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("__order"))
    if text_col in keep:
        slim = materialize(keyed.select("__source", "__size", "__order"))
    else:
        slim = keyed = materialize(keyed)
    sizes = materialize(slim.groupBy("__source").agg(F.sum("__size").alias("source_size")).select(_source_name("__source").alias("source"), "source_size"))
    wanted = targets(sizes, share, max_copies, block)
    wanted = materialize(wanted.select(_source_key(F.col("source")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("quota").alias("__quota"), F.col("block").alias("__block"), F.col("unit").alias("__unit")))
    wanted = small_or_joined(wanted, 50_000)  # rows are not dealt by source, one of which may hold most of them
    shard = F.pmod(F.col("__order"), F.greatest(F.lit(1), F.ceil(F.col("__source_size") / shard_words))).cast("int")
    shards = slim.join(wanted, "__source").withColumn("shard", shard).groupBy(F.col("__source").alias("source"), "shard").agg(F.sum("__size").alias("shard_size"), *[F.first(f"__{c}").alias(c) for c in ("quota", "block", "unit")])
    quotas = materialize(_shard_quotas(shards, max_copies))
    quotas = quotas.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.greatest("n_blocks", F.lit(1)).alias("__n_blocks"), F.col("passes").cast("int").alias("__passes"), F.col("rest").alias("__rest"))
    line = Window.partitionBy("__source", "__shard").orderBy("__order", "__size")
    rows = keyed.join(wanted, "__source").withColumn("__shard", shard)
    rows = rows.withColumn("__first", F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).join(small_or_joined(quotas, 50_000), ["__source", "__shard"])
    rows = rows.withColumn("__block_seed", F.xxhash64(F.lit(seed), "__source", "__shard"))
    part = taken_in_blocks(F.col("__first"), F.col("__size"), F.col("__n_blocks"), F.col("__rest"), F.col("__block_seed"), F.col("__block"))
    return rows.withColumn("__taken", (F.col("__passes") * F.col("__size") + part).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_copies: int = 2, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, and first, n_blocks, passes, rest, block and
    block_seed, which say where on its shard's line the row lies and what is taken of it.

    A source's taken words miss its target by a block or two for each of its shards; blocks are of `block` words, or of less where a
    source has fewer than sixteen of that length. Sizes are words; null and empty texts have 0 and give
    none. A null source is a source of its own, after the others. Repeated rows are documents of their own; rows that
    tie in seeded order have equal id and text and are interchangeable. Empty table: no rows.
    """
    rows = _placed(docs, [id_col], id_col, text_col, source_col, share, max_copies, block, shard_words, seed)
    names = ("size", "source_size", "target", "taken", "first", "n_blocks", "passes", "rest", "block", "block_seed")
    return rows.select(F.col(id_col).alias("doc_id"), _source_name("__source").alias("source"), *[F.col(f"__{c}").alias(c) for c in names])


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_copies: int = 2, block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as whole passes take it, and once more cut to
    the words of the blocks that the last pass takes (with the white space that follows them). n_chars, if there, is
    set anew. What mix() says of nulls, ties and repeated rows holds here."""
    rows = _placed(docs, docs.columns, id_col, text_col, source_col, share, max_copies, block, shard_words, seed).where("__taken > 0")
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = F.array_join(F.filter(words, lambda w, i: position(F.floor((F.col("__first") + i) / F.col("__block")), F.col("__n_blocks"), F.col("__block_seed")) < F.col("__rest")), "")
    copies = F.concat(F.array_repeat(F.col(text_col), F.col("__passes")), F.when(F.col("__taken") > F.col("__passes") * F.col("__size"), F.array(cut)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__text", F.explode(copies))
    new = {text_col: F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
