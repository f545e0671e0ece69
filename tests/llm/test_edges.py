"""Very long texts, empty tables, nulls, ties, repeated rows and clashing names, for the classifier and the pipeline against
plain computations."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_fp, brute_winnow, brute_words, words
from test_near_copies import shingles, similar

import corpus_pipeline
from kgloom.llm import mixing, quality, simhash, winnowing
from kgloom.llm.common import materialize
from kgloom.llm.queries import QUERIES, quality_model, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


# The classifier


def plain_model(rows, y, cost):
    """Log-count ratios by counting, and the hinge loss by dual coordinate ascent in plain Python until nothing moves."""
    pos, neg = Counter(), Counter()
    for f, v in zip(rows, y):
        (pos if v > 0 else neg).update(f)
    p, n = sum(pos.values()) + quality.DIM, sum(neg.values()) + quality.DIM
    r = {f: np.log((pos[f] + 1) / p) - np.log((neg[f] + 1) / n) for f in {*pos, *neg}}
    c = [cost * len(y) / (2 * sum(v == s for v in y)) for s in y]
    w, alpha = Counter(), [0.0] * len(y)
    for _ in range(3000):
        moved = 0.0
        for i, f in enumerate(rows):
            g = y[i] * (sum(w[k] * r[k] for k in f) + w["bias"]) - 1
            a = min(max(alpha[i] - g / (sum(r[k] ** 2 for k in f) + 1), 0.0), c[i])
            d, alpha[i] = (a - alpha[i]) * y[i], a
            moved = max(moved, abs(d))
            for k in f:
                w[k] += d * r[k]
            w["bias"] += d
        if moved < 1e-9:
            break
    return lambda f: sum(w[k] * r.get(k, 0.0) for k in f) + w["bias"]


def test_fit():
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(60):
        v = 1 if i % 3 else -1
        f = rng.choice(40, 8, replace=False) + (12 if v > 0 else 0)
        rows.append(np.unique(f).astype(np.int32))
        y.append(v)
    counts = np.ones((2, quality.DIM))
    for f, v in zip(rows, y):
        counts[int(v > 0), f] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    c = np.array([0.1 * 60 / (2 * sum(v == s for v in y)) for s in y])
    w = quality._descend(rows, r, np.array(y, float), c, rounds=3000)
    plain = plain_model([f.tolist() for f in rows], y, 0.1)
    assert np.allclose([w[f] @ r[f] + w[-1] for f in rows], [plain(f.tolist()) for f in rows], atol=2e-2)


def test_features(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["word", "Äpfel", "12", "...", "\n", "X"]) for _ in range(3000))
    whole = quality.features(text).tolist()
    monkeypatch.setattr(quality, "_CHUNK", 64)
    assert quality.features(text).tolist() == whole and quality.features(None).tolist() == quality.features("").tolist() == []
    short = ["a", "b"] * 100
    assert quality._repeated(short) == pytest.approx(quality._repeated(short * 200), abs=0.02)  # the same measure at any length
    assert quality._repeated([str(i).encode() for i in range(9000)]) == 0


def test_score_replaces_its_column(spark):
    docs = spark.createDataFrame([(1, "x", 9.0)], "doc_id long, text string, score double")
    out = quality.score(docs, (np.zeros(quality.DIM + 1, np.float32), 1.0, 0.0))
    assert out.columns == ["doc_id", "text", "score"] and out.first()["score"] == 0.5


# Very long texts


def test_long_texts(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 4) for _ in range(70_000))
    df = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    fps = {r["id"]: r["fp"] & (1 << 64) - 1 for r in simhash.simhash_groups(df, shingle=3).collect()}
    assert fps == {1: brute_fp(text), 2: brute_fp(text + " x")}
    cut = " ".join(text.split()[:20_000])
    r = winnowing.fingerprints(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()
    got, want = r["entries"], brute_winnow(cut)
    assert got == want


# The pipeline


def save(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_plain(spark, sf):
    """Each stage on what its predecessor kept, against brute force, on the smallest tables."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    first = rows(docs)
    w, a, b = quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = materialize(stages["quality classifier"](spark, docs, sf))
    margin = {d: a * (w[quality.features(t)].sum(dtype=float) + w[-1]) + b for d, t in first.items()}
    assert rows(good) == {d: t for d, t in first.items() if margin[d] >= 0}

    left = sorted(rows(good).items())
    sets, root = [shingles(t) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                lo, hi = min(root[i], root[j]), max(root[i], root[j])
                root = [lo if x == hi else x for x in root]
    apart = materialize(stages["simhash near-dedup"](spark, good, sf))
    assert rows(apart) == {d: t for i, (d, t) in enumerate(left) if root[i] == i}

    before = apart.collect()
    cut = materialize(stages["suffix-array dedup"](spark, apart, sf))
    assert rows(cut) == {r["doc_id"]: x[2].decode() for r, x in zip(before, brute_words([(r["text"] or "").encode() for r in before], 50))}
    runs = Counter(tuple(ws[i : i + 50]) for t in rows(cut).values() for ws in [words(t)] for i in range(len(ws) - 49))
    assert len(before) == cut.count() and max(runs.values(), default=0) <= 1
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = materialize(stages["source mixing"](spark, cut, sf))
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(words(r["text"]))
    assert {d: n for d, n in taken.items() if n} == {r["doc_id"]: r["taken"] for r in mixing.mix(cut).collect() if r["taken"]}

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    packed = stages["best-fit packing"](spark, mixed, sf).collect()
    want = Counter()
    for r in mixed.collect():
        n = len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], i, min(2048, n - 2048 * i)) for i in range(-(-n // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == want


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, and a single label class."""
    rng = random.Random(5)
    text, other = (" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)) for _ in range(2))
    docs = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0), (None, text, None, "a", None), (None, None, None, None, None), (4, other, "de", None, 1), (5, " \n", "", "", 3)]
    sf_dir = save(spark, tmp_path, docs, [(1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 0)])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    seqs = Counter()
    for r in out:
        seqs[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in out} == {1, 4} and max(seqs.values()) <= 2048
    assert {r["doc_id"] for r in QUERIES["op5_quality_classifier"](spark, sf_dir).collect()} == {1, 2, 3, 4, 5, None}


def test_empty_tables(spark, tmp_path):
    sf_dir = save(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    assert QUERIES["op5_quality_classifier"](spark, sf_dir).count() == 0 and QUERIES["op8_suffix_array_dedup"](spark, sf_dir).count() == 0


def test_stages_keep_extra_columns(spark, tmp_path):
    """Columns named like those that stages use inside stay as they are."""
    names = ["kept", "score", "id", "th", "row", "spans", "component", "fp", "sh", "cluster", "size", "target", "taken", "shard", "length", "place"]
    docs = spark.createDataFrame([(i, f"text number {i} of some words", "en", "ab"[i % 2], 5) for i in range(6)], DOCS).withColumns({c: F.lit(c) for c in names})
    sf_dir = save(spark, tmp_path, [(1, "x", "en", "a", 1)], [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns[5:] == names and all(r[c] == c for r in docs.collect() for c in names)
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() > 0
