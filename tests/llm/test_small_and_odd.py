"""Small sources, corpora of a few words, pages with quotes that never close and vectors of extreme length."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_edges import save

import corpus_pipeline
from kgloom.llm import hnsw, html_text, mixing

SOURCES = "doc_id long, text string, source string"


@pytest.mark.parametrize("size,count", [(20, 50), (1, 30), (70, 9), (1000, 4)])
def test_small_sources(spark, size, count):
    rng = random.Random(size)
    rows, sizes = [], Counter()
    for s in range(count):
        left = size + s % 3
        sizes[s] = left
        while left:
            n = min(left, rng.randrange(1, 9))
            rows.append((len(rows), " ".join(["w"] * n), f"s{s:02d}"))
            left -= n
    got = mixing.mix(spark.createDataFrame(rows, SOURCES)).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in range(count):
        mine = [r for r in got if r["source"] == f"s{s:02d}"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(1.0, sizes[s] / 16)
    target = sum({r["source"]: r["target"] for r in got}.values())
    assert abs(target - 1.5 * sum(sizes.values())) < 1e-6 and abs(sum(r["taken"] for r in got) - target) <= max(2.0, 0.02 * target)


def test_ten_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "h i j", "x"), (3, None, "x"), (4, "", None)], SOURCES)
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == 15
    words = Counter()
    for r in mixing.mixed_texts(docs).collect():
        words.update(r["text"].split())
    assert sum(words.values()) == 15 and set(words) == set("abcdefghij")


def test_short_pipeline(spark, tmp_path):
    """A corpus of under half a block goes through all stages."""
    text = "A quiet river runs along the old town and past the mill where people meet on market days to talk."
    docs = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0), (None, text, None, "a", None), (4, text + " And more of it.", "de", None, 1), (5, " \n", "", "", 3)]
    out = corpus_pipeline.run(spark, save(spark, tmp_path, docs, [(1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 0)])).collect()
    assert out and max(Counter({r["sequence_id"]: r["length"] for r in out}).values()) <= 2048


@pytest.mark.parametrize("piece,tail", [("<a ", '"'), ("<a ", "'"), ("<a x=", '"'), ('<a "', ""), ("<a '\"", ""), ("<!-", ""), ("< ", ">")])
def test_unclosed_quotes(piece, tail):
    page = f"<html><body><article><p>Kept text.</p></article>{piece * (1_000_000 // len(piece))}{tail}"
    began = time.perf_counter()
    assert html_text.lines_of(page)[0] == ("Kept text.", html_text.OWN)
    assert time.perf_counter() - began < 5


def test_closed_after_unclosed():
    assert [x for x, _ in html_text.lines_of("<p title='a>b'>One</p><p>Two</p>")] == ["One", "Two"]
    assert [x for x, _ in html_text.lines_of('<p>One</p><p title="never>Two</p><p>Three</p>')] == ["One"]


def test_extreme_lengths(spark):
    v = [[1e-170, 0.0], [1e-170, 0.0], [1e200, 0.0], [2e200, 0.0], [5e-324, 5e-324], [1.0, 1.0], [0.0, 0.0], [float("inf"), 1.0], [float("nan"), 1.0], None, [1e308, 1e308], [0.0, 1e-300]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (2, 4), 5: (2, 4), 10: (2, 4), 11: (0, 11), **{i: (0, i) for i in (6, 7, 8, 9)}}
    assert hnsw.near_duplicates(df.where(F.col("vec_id") < 0)).count() == 0


def test_words_remembered():
    """Few remembered words bound a worker's memory and change no ids."""
    from kgloom.llm.packing import WordIds
    from kgloom.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    few, all_ = WordIds(path, 8), WordIds(path)
    for i in range(40):
        text = " ".join(f"word{i * j % 13} the Fall{i}" for j in range(1 + i % 9))
        assert few(text) == all_(text)
        assert len(few.seen) <= 8
    assert few("") == b"" and few(None) == b""
