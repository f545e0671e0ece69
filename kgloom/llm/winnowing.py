"""Document fingerprints by winnowing, in DataFrame functions alone.

Hashes of the k-grams of words; each window of w of them keeps its least one, the rightmost of equal ones, with its
position. Two texts that share k + w - 1 words in a row share a kept hash. A kept entry is one number: 38 bits of the
hash, then 26 bits of position counted down, so that a plain minimum breaks ties to the right. A text of 2^26 words or
more (over 128 MB) is an error. A k-gram's hash is made of the hashes of its k words, each hashed once: array functions
can't carry a rolling sum from one element to the next without copying the array, and for five words it would save little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

K, W = 5, 16
POSITION_BITS = 26
_LOW = (1 << POSITION_BITS) - 1


def winnow(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds out: the kept entries in order (array<bigint>). Fewer than k words: their one gram; no word: empty.
    w must be a power of two."""
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    words = F.split(F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")), " +")
    df = df.withColumn("__words", words)
    df = df.withColumn("__h", F.filter(F.transform("__words", lambda x: F.xxhash64(x)), lambda x: x != F.xxhash64(F.lit(""))))
    n = F.size("__h")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("__h", i + j) for j in range(k)]).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i))
    df = df.withColumn("__v", F.when(n > _LOW, F.raise_error(F.lit("a text of too many words"))).when(n > 0, grams).otherwise(F.array().cast("array<bigint>")))
    span = 1
    while span < w:  # least of 2, 4, 8 ... in a row; zip_with pads with nulls, which least ignores
        df = df.withColumn("__v", F.zip_with("__v", F.slice("__v", span + 1, F.greatest(F.size("__v") - span, F.lit(0))), lambda a, b: F.least(a, b)))
        span *= 2
    df = df.withColumn(out, F.array_distinct(F.slice("__v", F.lit(1), F.greatest(F.size("__v") - (w - 1), F.least(F.lit(1), F.size("__v"))))))
    return df.drop("__words", "__h", "__v")


def hashes(entries: str) -> Column:
    return F.array_distinct(F.transform(entries, lambda v: F.shiftright(v, POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_string(entries: str) -> Column:
    """The entries in hexadecimal, 16 digits each, space-joined."""
    return F.array_join(F.transform(entries, lambda v: F.lpad(F.hex(v), 16, "0")), " ")


def with_next(df: DataFrame, id_col: str, carried: list[str], tie: Column) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row by descending id, after the last: the first.

    The order is cut at quantiles of the ids (at most 4096 numbers at the driver); the head of each range is dealt to the
    range above it as well, so no task sees more than its range. Equal ids go by tie; a null id counts as least.
    """
    own = [c for c in df.columns]
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    df = df.withColumn("__id", ids)
    n = min(4096, 4 * parts(df.sparkSession))
    cuts = df.agg(F.percentile_approx("__id", [i / n for i in range(1, n + 1)], 100 * n).alias("q")).first()["q"] or [0]

    def bucket(bounds: list[int]) -> Column:
        """Number of bounds below the id, by binary search."""
        steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
        array = F.array(*[F.lit(b).cast("long") for b in bounds])
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: lo + F.when(F.get(array, lo + s - 1) < F.col("__id"), s).otherwise(F.lit(0)))

    cuts = sorted(set(cuts))
    tops = sorted(r["top"] for r in df.select("__id", bucket(cuts).alias("b")).groupBy("b").agg(F.max("__id").alias("top")).collect()) or [0]
    df = df.withColumn("__b", bucket(tops))
    top = F.get(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("__b"))
    places = F.when(F.col("__id") == top, F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("s")), F.struct(((F.col("__b") + 1) % len(tops)).alias("b"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("s"))))
    rows = df.withColumn("__tie", tie).withColumn("__p", F.explode(places)).withColumn("__b", F.col("__p.b")).withColumn("__s", F.col("__p.s")).drop("__p")
    order = Window.partitionBy("__b").orderBy("__s", F.col("__id").desc(), "__tie")
    led = rows.select(*own, "__s", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where("__s = 0").drop("__s")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(id_col, text, entries, hashes) of every row; a null text is empty."""
    base = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return winnow(base, "text", "entries", k, w).withColumn("hashes", hashes("entries"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half, in code points, replaced by as much of the
    beginning of the next document), and their likeness."""
    f = fingerprints(docs, id_col, text_col)
    f = with_next(f, id_col, ["text", "hashes"], F.xxhash64("text"))
    n = F.char_length("text")
    f = f.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    f = f.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substr("next_text", F.lit(1), F.col("half"))))
    f = f.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text")
    f = winnow(f, "edited", "edited_entries").withColumn("edited_hashes", hashes("edited_entries"))
    return f.select(id_col, "n_chars", "edited_sha256", as_string("entries").alias("fingerprint"), as_string("edited_entries").alias("edited_fingerprint"), likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))
