"""The corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents for all but the last. A
stage works on every row its predecessor kept. run() cuts the lineage with a checkpoint after each stage, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, read_table
from kgloom.llm.mixing import mixed_texts
from kgloom.llm.near_copies import near_copy_dedup
from kgloom.llm.packing import pack
from kgloom.llm.quality import score
from kgloom.llm.queries import quality_model, tokenizer_path
from kgloom.llm.suffix_dedup import Cut, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    model = quality_model(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, out="__score").where("__score >= 0.5").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more) stays: the one of smallest
    doc_id."""
    return near_copy_dedup(docs, shingle=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every word of a passage of 50 words or more that also starts elsewhere; no document goes."""
    cut = suffix_dedup(docs, cuts=(Cut("words", 50),), out="__repeats").withColumn("__kept", F.col("__repeats.words.kept").cast("string"))
    new = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as their source's target takes."""
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences of at most 2048."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048, remember=1 << 17)  # workers keep what they remember beside later stages


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("source mixing", mixture), ("best-fit packing", packing)]
#: SQL can't express the classifier's fit, XXH64 fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
