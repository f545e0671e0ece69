"""The pipeline's near-copy stage against brute force."""

import random

import pytest

import corpus_pipeline
from kgloom.llm import near_copies


def shingles(t, k=5):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


@pytest.mark.parametrize("chunk", [2048, 7])
def test_near_copies(spark, chunk):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    texts = [None, "", " \n", "One two", "one two", "one three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(40, 200))]
        texts.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(120)]
    for _ in range(60):  # a hot group
        w = list(base)
        w[rng.randrange(120)] = word()
        w[rng.randrange(120)] = word()
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in near_copies.near_copy_groups(df, chunk=chunk).collect():
        got.setdefault(r["component"], []).append(r["__id"])
    want = {}
    for i, x in enumerate(root):
        want.setdefault(x, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(want.values())
    if chunk > 7:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(want)
        assert near_copies.near_copy_dedup(df.limit(0)).count() == 0
        odd = spark.createDataFrame([(None, "x y z"), (None, "q r s t"), (5, "x y z"), (5, "other words"), (5, "x y z"), (None, "q r s t")], "doc_id long, text string")
        assert sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.near_copy_dedup(odd).collect()) == [(0, "q r s t"), (5, "other words"), (5, "x y z")]
