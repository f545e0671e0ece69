"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

Cuts are chosen in units of a text (lines, or code points) and made in its UTF-8 bytes. A text's index records only its
multibyte characters: place in code points, place in bytes and running excess of bytes over code points. Between two of them a
cut is moved by plain arithmetic, and a binary search finds between which ones it lies, so an ASCII text has an empty index
whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: Rows turned into one Arrow batch.
SLICE = 256


class CharIndex:
    """Where the multibyte characters of a UTF-8 text are; converts cuts between code points and bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)  # first bytes of multibyte characters
        lead = data[self.at]
        self.excess = np.append(0, np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0)))
        self.points = self.at - self.excess[:-1]
        self.n_points = len(data) - int(self.excess[-1])

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """cuts lie at the ends of characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]


def numbers(seed: int, key: str) -> list[int]:
    """The four numbers that decide over a document."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(data: bytes, key: str, unit: str, rate: int, spm_rate: int, seed: int, sentinels: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    buf = np.frombuffer(data, np.uint8)
    index = CharIndex(buf)
    h1, h2, h3, h4 = numbers(seed, key)
    if unit == "chars":
        n = index.n_points
    else:
        ends = np.append(0, np.flatnonzero(buf == 10) + 1)
        if len(data) > ends[-1]:
            ends = np.append(ends, len(data))
        n = len(ends) - 1
    p, s, m = (x.encode() for x in sentinels)
    if not data or p in data or s in data or m in data or h3 % 100 >= rate:
        return n, "plain", None, None, data
    units = np.sort([h1 % (n + 1), h2 % (n + 1)])
    points, cuts = (units, index.to_bytes(units)) if unit == "chars" else (index.to_points(ends[units]), ends[units])
    (a, b), chars = cuts.tolist(), points.tolist()
    if h4 % 100 < spm_rate:
        return n, "spm", chars[0], chars[1] - chars[0], b"".join([s, data[b:], p, data[:a], m, data[a:b]])
    return n, "psm", chars[0], chars[1] - chars[0], b"".join([p, data[:a], s, data[b:], m, data[a:b]])


NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and
    output, the text as it is trained on. unit is "lines" (each with its newline) or "chars".

    rate and spm_rate are percent. sentinels stand before prefix, suffix and middle; no two may overlap. A text that is empty or
    holds one of them stays plain. A null text is empty; a null id counts as the empty string; equal ids get equal numbers. Empty
    table: no rows. Columns named like the new ones are replaced.
    """
    if unit not in ("lines", "chars"):
        raise ValueError(f"no such unit: {unit}")
    kept = [c for c in docs.columns if c not in NEW]
    own = [F.col(f"`{c}`") for c in kept]
    keyed = docs.select(*own, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts = part.column(len(kept) + 1).cast(pa.binary()).to_pylist()
                keys = part.column(len(kept)).to_pylist()
                n, form, prefix, middle, output = zip(*[transform(t, k, unit, rate, spm_rate, seed, sentinels) for t, k in zip(texts, keys, strict=True)], strict=True)
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], [*kept, *NEW])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {t}" for c, t in NEW.items())])
    return keyed.mapInArrow(run, schema)


def restored(output: str | Column = "output", form: str | Column = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone: a text that isn't plain holds each sentinel once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
