"""Quality classifier: naive Bayes support vectors.

A text's n-gram indicators are scaled by class log-count ratios and a linear hinge-loss model is fitted on them by dual
coordinate descent; Platt's sigmoid turns margins into scores. The n-grams are byte 3-grams, and 3-grams of the text's
shape (runs of lower case, upper case and digits become one symbol) and word repetitions, each of these with an
indicator per share of the text that it makes up.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

BYTE_DIM, SHAPE_DIM, REPEAT_DIM = 1 << 16, 1 << 14, 16
#: An n-gram of the shape has an indicator for each of these shares that it reaches.
SHARES = (0.0, 1 / 32, 1 / 8, 3 / 8)
DIM = BYTE_DIM + (SHAPE_DIM + REPEAT_DIM) * len(SHARES)
_CHUNK = 1 << 22
_CLASS = bytes(32 if c in (9, 10, 11, 12, 13, 32) else ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def _grams(a: np.ndarray, dim: int) -> Iterator[np.ndarray]:
    for at in range(0, max(0, len(a) - 2), _CHUNK):
        p = a[at : at + _CHUNK + 2].astype(np.uint32)
        yield ((p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA6B) + p[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(8)) % np.uint32(dim)


def _repeated(words: list[bytes], span: int = 256) -> float:
    """Share of words that occurred before within their stretch of span words: the same measure for texts of any length.
    Fewer than 8 words: none."""
    if len(words) < 8:
        return 0.0
    return 1 - sum(len(set(words[at : at + span])) for at in range(0, len(words), span)) / len(words)


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the indicators that are on; none for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, np.int32)
    on = np.zeros(BYTE_DIM, bool)
    for g in _grams(np.frombuffer(raw, np.uint8), BYTE_DIM):
        on[g] = True
    shape = np.frombuffer(raw.translate(_CLASS), np.uint8)
    runs = np.ones(len(shape), bool)
    runs[1:] = (shape[1:] != shape[:-1]) | ((shape[1:] != 97) & (shape[1:] != 65) & (shape[1:] != 48) & (shape[1:] != 32))
    shape = shape[runs]
    count = np.zeros(SHAPE_DIM + REPEAT_DIM, np.int64)
    for g in _grams(shape, SHAPE_DIM):
        count[:SHAPE_DIM] += np.bincount(g, minlength=SHAPE_DIM)
    words = raw.lower().split()
    share = np.zeros(SHAPE_DIM + REPEAT_DIM)
    share[:SHAPE_DIM] = count[:SHAPE_DIM] / max(1, len(shape) - 2)
    for d in range(1, 5):
        if len(words) > d:
            share[SHAPE_DIM + d] = sum(map(operator.eq, words, words[d:])) / (len(words) - d)
    lines = raw.split(b"\n")
    share[SHAPE_DIM + 5] = 1 - len(set(lines)) / len(lines)
    share[SHAPE_DIM + 6] = max(0.0, _repeated(words) - 0.3)
    out = [np.flatnonzero(on)]
    for i, s in enumerate(SHARES):
        out.append(BYTE_DIM + i * (SHAPE_DIM + REPEAT_DIM) + np.flatnonzero(share > s))
    return np.concatenate(out).astype(np.int32)


def _descend(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the last weight is the bias's. c: the cost of each row."""
    w, alpha, rng = np.zeros(len(r) + 1), np.zeros(len(rows)), np.random.default_rng(42)
    x = [r[f] for f in rows]
    norm = np.array([v @ v + 1 for v in x])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + w[-1]) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), c[i])
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                worst = max(worst, abs(step) * norm[i])
                w[rows[i]] += step * x[i]
                w[-1] += step
                alpha[i] = a
        if worst < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * margin * margin).sum() + 1e-6, (h * margin).sum(), h.sum() + 1e-6
        ga, gb, det = (d * margin).sum(), d.sum(), 0.0
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1) -> tuple[np.ndarray, float, float]:
    """Weights (bias last) and the sigmoid's two numbers. A single class, or no row: a constant score."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        return np.zeros(DIM + 1), 1.0, 0.0 if not len(y) else 5.0 * y[0]

    def model(which: np.ndarray) -> np.ndarray:
        counts = np.ones((2, DIM))
        for i in which:
            counts[int(y[i] > 0), rows[i]] += 1
        r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        per = {s: cost * len(which) / (2 * max(1, (y[which] == s).sum())) for s in (1.0, -1.0)}
        w = _descend([rows[i] for i in which], r, y[which], np.array([per[v] for v in y[which]]))
        return np.append(w[:-1] * r, w[-1])

    held = np.arange(len(y)) % 4 == 0
    if min((y[~held] > 0).sum(), (y[~held] < 0).sum(), (y[held] > 0).sum(), (y[held] < 0).sum()) < 2:
        held = np.zeros(len(y), bool)
    part = model(np.flatnonzero(~held))
    at = np.flatnonzero(held) if held.any() else np.arange(len(y))
    a, b = _platt(np.array([part[rows[i]].sum() + part[-1] for i in at]), y[at])
    return model(np.arange(len(y))), a, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000) -> tuple[np.ndarray, float, float]:
    """Fits on at most max_rows labelled rows, those of least hash of their id: a documented bound on what the one
    fitting task gets. Rows with a null label are no labels; of a repeated id one row of text is used."""
    chosen = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id")  # bounded by max_rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            f = [features(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["id", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {}
        for b in batches:
            for d, y, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got[d] = max(got.get(d, (f, y)), (f, y))
        order = sorted(got)
        w, a, c = fit_rows([np.frombuffer(got[d][0], np.int32) for d in order], np.array([got[d][1] for d in order]))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([a]), pa.array([c])], ["w", "a", "b"])

    row = texts.select("__id", "__y", "__text").mapInArrow(extract, "id long, y int, f binary").repartition(1).mapInArrow(train, "w binary, a double, b double").first()
    return np.frombuffer(row["w"], "<f4"), row["a"], row["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (higher: better) from the whole text alone; a null text scores as an empty one. A column
    of docs that is named like the score is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema.fields]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, c = shared.value
        for b in sliced(batches):
            margin = np.fromiter((w[features(t)].sum(dtype=np.float64) + w[-1] for t in b.column(at).to_pylist()), np.float64, b.num_rows)
            s = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*names, out])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` double"])
    return docs.mapInArrow(run, ddl)
