"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates share one of 16 bands of 4 min-hashes (at a similarity of 0.8 a pair shares none with probability 0.0002) or
lie within 3 bits of each other's SimHash (covering masks, so none of those is missed). A pair links only if its shingle
sets, compared in full, reach the similarity. Documents of equal sets are one row in the search.

Candidate pairs are joined to clusters on ids alone. Then every set goes to its cluster, where all pairs that could join
two groups are compared. Clusters of over CHUNK sets are dealt to tasks as pairs of chunks, so no task holds more than
two; the sets of such a cluster are sent once for each of its chunks, and comparing them grows with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, components, first_rows, materialize, row_key, sliced
from .simhash import fingerprint_bits, near_edges, shingle_hashes

BANDS, ROWS, RADIUS = 16, 4, 3
CHUNK = 2048
_MULT = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _bands(h: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):  # bounds the matrix of a very long text
        low = np.minimum(low, (h[at : at + 4096, None] * _MULT + _ADD).min(0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, ROWS))]


def _set_of(text: str | None, shingle: int) -> np.ndarray:
    h = shingle_hashes(text, shingle)
    return np.zeros(0, np.uint64) if h is None else np.unique(h)


def _signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """ROW_KEY, sh, n, fp, bands per row: hash of the shingle set, size of the set, SimHash, min-hash bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sh, n, fp, bands = [], [], np.zeros(b.num_rows, np.uint64), []
            for i, text in enumerate(b.column(3).to_pylist()):
                h = shingle_hashes(text, shingle)
                s = np.zeros(0, np.uint64) if h is None else np.unique(h)
                sh.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                n.append(len(s))
                bands.append(np.array(_bands(s) if len(s) else [], np.uint64).view(np.int64).tolist())
                if h is not None:
                    fp[i] = fingerprint_bits(h)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(sh, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(fp.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], [*ROW_KEY, "sh", "n", "fp", "bands"])

    key = [c.alias(n) for n, c in row_key(id_col, text_col).items()]
    return docs.select(*key, F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "__n boolean, __id long, __th long, sh long, n long, fp long, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(sh, cluster, s): the shingle set of each text (sh, cluster, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = [_set_of(t, shingle).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.binary())], ["sh", "cluster", "s"])

    return texts.mapInArrow(run, "sh long, cluster long, s binary")


def _clusters(sets: DataFrame) -> DataFrame:
    """(id, cluster): sets (sh, fp, bands) that candidate pairs join, at whatever number of steps."""
    band = sets.select("sh", F.explode("bands").alias("key"))
    pairs = band.join(band.groupBy("key").agg(F.min("sh").alias("least"), F.count("*").alias("c")).where("c > 1"), "key").select(F.col("least").alias("a"), F.col("sh").alias("b"))
    same = materialize(sets.groupBy("fp").agg(F.min("sh").alias("least")))
    pairs = pairs.unionByName(sets.join(same, "fp").select(F.col("least").alias("a"), F.col("sh").alias("b")))
    near = near_edges(same.select("fp"), RADIUS).toDF("fa", "fb")
    ends = lambda f, c: same.select(F.col("fp").alias(f), F.col("least").alias(c))
    pairs = pairs.unionByName(near.join(ends("fa", "a"), "fa").join(ends("fb", "b"), "fb").select("a", "b"))
    pairs = materialize(pairs.where("a <> b").distinct())
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return materialize(components(nodes, pairs).withColumnRenamed("component", "cluster"))


def _links(sets: list[np.ndarray], side: np.ndarray, lo: int, hi: int, tenths: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets. Of two chunks only links across them are looked at."""
    size = np.array([len(x) for x in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    comp, found, flag = np.arange(len(sets)), [], np.zeros(len(vocabulary), np.int32)
    for i in np.flatnonzero(side == lo):
        if not ((comp != comp[i]) & (side == hi)).any():
            continue
        own = flat[start[i] : start[i] + size[i]]
        flag[own] = 1
        both = np.add.reduceat(flag[flat], start)
        flag[own] = 0
        for j in np.flatnonzero((10 * both >= tenths * (size + size[i] - both)) & (side == hi)):
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                found.append((i, j))
    return found


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8, chunk: int = CHUNK) -> DataFrame:
    """ROW_KEY and component, which names a group of near copies, per row."""
    sig = materialize(_signatures(docs, id_col, text_col, shingle))
    cluster = _clusters(sig.where("n > 0").groupBy("sh").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    one = sig.groupBy("sh").agg(F.min(F.struct(*ROW_KEY)).alias("x")).join(cluster, F.col("sh") == F.col("id")).select("x.*", "sh", "cluster")  # one row's text for each set
    keyed = docs.select(*[c.alias(n) for n, c in row_key(id_col, text_col).items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = keyed.join(one, ROW_KEY).dropDuplicates(ROW_KEY)
    k = F.ceil(F.col("c") / chunk).cast("int")
    chunks = cluster.groupBy("cluster").agg(F.count("*").alias("c")).select("cluster", k.alias("k"))
    rows = _sets(texts.select("sh", "cluster", "text"), shingle).join(chunks, "cluster")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sh"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "sh", "s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sh")
        lo, hi, sh = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["sh"].to_numpy()
        found = _links([np.frombuffer(x, np.uint64) for x in pdf["s"]], pdf["own"].to_numpy(), lo, hi, tenths)
        return pd.DataFrame([(sh[i], sh[j]) for i, j in found], columns=["a", "b"])

    edges = materialize(rows.groupBy("cluster", "lo", "hi").applyInPandas(run, "a long, b long"))
    comp = materialize(components(cluster.select("id"), edges))
    return sig.select(*ROW_KEY, "sh").join(comp.withColumnRenamed("id", "sh"), "sh", "left").select(*ROW_KEY, F.coalesce("component", "sh").alias("component"))


def near_copy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of docs that first_rows() keeps of groups of near copies."""
    return first_rows(docs, near_copy_groups(docs, id_col, text_col, shingle), id_col, text_col)
