"""Registered queries over all documents of the smallest tables against brute force."""

import json
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers
from test_llm_operators import TOKENIZER, brute_edited, brute_fp, union, words

from kgloom.llm import mixing
from kgloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_source_mixing"](spark, sf).collect()}
    size, by = {d: len(words(t)) for d, (t, _) in docs.items()}, Counter()
    for d, (_, s) in docs.items():
        by[s] += size[d]
    order = sorted((s for s in by if s is not None), key=lambda s: s) + [None] * (None in by)
    want = dict(zip(order, mixing.water_fill(np.resize(np.array([5.0, 2.0, 1.0]), len(order)), np.array([2.0 * by[s] for s in order]), 1.5 * sum(by.values())), strict=True))
    taken = Counter()
    for d, (_, s) in docs.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (size[d], by[s]) and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert got.keys() == docs.keys() and all(abs(taken[s] - want[s]) <= 128 for s in order)


def test_op3(spark, sf, docs):
    ids = sorted(docs)
    fps = [brute_fp(docs[d][0]) for d in ids]
    comp = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, sf).collect()}
    assert got == {d: (f"{fps[i]:016x}", ids[comp[i]]) for i, d in enumerate(ids)}


def test_op4(spark, sf, docs):
    import zlib

    tok = tokenizers.Tokenizer.from_file(TOKENIZER)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, (t, _) in docs.items()}
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    places = {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(piece) == r["length"] == min(2048, len(ids[r["doc_id"]]) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in rows) == {d: -(-len(x) // 2048) for d, x in ids.items()}
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_op7(spark, sf, docs):
    """Words by the public tokenizer's own normalizer and splitter, then the longest piece of what is left, again and again."""
    tok = tokenizers.Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        vocabulary = set(json.load(f)["model"]["vocab"])

    def pieces(word):
        n = 0
        while word:
            if f"{word}</w>" in vocabulary:
                return n + 1
            size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
            if not size:
                return 1
            n, word = n + 1, word[size:]
        return n

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in QUERIES["op7_token_counts"](spark, sf).collect()}
    for d, (t, _) in docs.items():
        found = [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(t or ""))]
        assert got[d] == (len((t or "").split()), sum(map(pieces, found))), d
    assert got.keys() == docs.keys()


def test_op9(spark, sf, docs):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op9_winnowing_fingerprints"](spark, sf).collect()}
    assert got == brute_edited([(d, t) for d, (t, _) in docs.items()])


def test_op10(spark, sf):
    """The article's blocks, cut out by plain patterns where the page has one article and no marked parts within it."""
    import html

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op10_html_extraction"](spark, sf).collect()}
    assert got.keys() == pages.keys() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    plain = 0
    for i, page in pages.items():
        m = re.fullmatch(r"(?s).*<article[^>]*>(.*)</article>.*", page)
        if not m or page.count("<article") != 1 or re.search(r"(?i)<(?!/?(?:p|h[1-6]|b|i|em|strong|a|br|li|ul|ol|blockquote)\b)", m[1]) or re.search(r"(?i)\b(?:class|id|role|hidden)\b", m[1]):
            continue
        blocks = re.split(r"(?i)</?(?:p|h[1-6]|br|li|ul|ol|blockquote)\b[^>]*>", m[1])
        text = " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert got[i]["text"] == text
        plain += 1
    assert plain > 0
