"""Each training-data operator against brute force, on small tables with nulls, empty texts, ties, repeated rows, extra
columns and hot groups."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgloom.llm import chat, common, hnsw, html_text, mixing, packing, quality, simhash, suffix_dedup, token_counts, winnowing
from kgloom.llm.queries import ORACLES, QUERIES, tokenizer_path

DOC = "doc_id long, text string"
TOKENIZER = tokenizer_path("word_bpe_49k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# SimHash


def brute_fp(t, k=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover():
    rng = random.Random(1)
    m = simhash.masks(3)
    assert len(m) == 15
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(x & k == 0 for k in m)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_simhash(spark, chunk):
    rng = random.Random(2)
    base = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(400))
    texts = [None, "", " \t\n", "One", "one", "a b", "ÉA b c"] + [base] * 5
    for _ in range(60):
        w = base.split()
        w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_groups(df, shingle=3, chunk=chunk).collect()}
    fps = [brute_fp(t) for t in texts]
    comp = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got == {i: (fps[i], comp[i]) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in simhash.simhash_dedup(df, shingle=3).collect())
    assert kept == sorted(set(comp))
    assert simhash.simhash_groups(df.limit(0), shingle=3).count() == 0
    odd = spark.createDataFrame([(None, "x y z"), (None, "q r s t"), (5, "x y z"), (5, "other words"), (5, "x y z"), (None, "q r s t")], DOC)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.simhash_dedup(odd, shingle=3).collect()) == [(0, "q r s t"), (5, "other words"), (5, "x y z")]


# Suffix arrays


def brute_spans(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        edge = np.diff(gone.astype(int))
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((len(t), len(t) - len(kept), int((edge == 1).sum()), kept))
    return out


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(200):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50))) for _ in range(rng.randrange(1, 40))]
        s += rng.sample(s, len(s) // 2)
        assert [s[i] for i in suffix_dedup.deep_shallow_sort(s, rng.choice([0, 8, 16]))] == sorted(s)


def brute_words(texts, n):
    """(bytes removed, runs, text left): words of n-word strings that start twice go, with the white space after them."""
    ws = [[(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen = Counter(tuple(x for _, x in w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, ws):
        gone = np.zeros(len(w) + 2, bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(x for _, x in w[i : i + n])] > 1:
                gone[i + 1 : i + n + 1] = True
        starts = [s for s, _ in w] + [len(t)]
        kept = t[: starts[0]] + b"".join(t[starts[i] : starts[i + 1]] for i in range(len(w)) if not gone[i + 1])
        out.append((len(t) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), kept))
    return out


@pytest.mark.parametrize(("n", "hot"), [(12, 2048), (12, 3), (40, 2), (1, 2048), (3, 1)])
def test_suffix_dedup(spark, n, hot):
    rng = random.Random(n + hot)
    passages = ["".join(rng.choice("abcdé ") for _ in range(2 * n)) for _ in range(4)]
    texts = [None, "", "a" * 90, "ab" * 60, " \t\n", "a b\tc  d\n" * 30]
    for _ in range(60):
        t = "".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(3 * n)] + "".join(rng.choice("qrstuv ") for _ in range(rng.randrange(20)))
        texts.append(t)
    common = [rng.choice("abc") * rng.randrange(1, 3) for _ in range(3 * n)]
    for _ in range(40):
        a = rng.randrange(2 * n)
        own = lambda: [rng.choice("uvwxyz") for _ in range(rng.randrange(4))]
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join([*own(), *common[a : a + rng.randrange(2 * n)], *own()]))
    rows = list(enumerate(texts + texts[4:9])) + [(7, texts[7]), (None, "null id"), (None, "null id")]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("id", "th", "begin", "kept", "row", "spans", "repeats")})
    raw = [(t or "").encode() for _, t in rows]
    cuts = (suffix_dedup.Cut("bytes", n), suffix_dedup.Cut("words", max(1, n // 3)))
    out = suffix_dedup.suffix_dedup(df, cuts, hot=hot)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["kept"], *((x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in (r["repeats"]["bytes"], r["repeats"]["words"]))) for r in out.collect()]
    want = [(d, "clash", (x[1], x[2], x[3]), y) for (d, _), x, y in zip(rows, brute_spans(raw, n), brute_words(raw, max(1, n // 3)))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix_dedup.suffix_dedup(df.limit(0), cuts).count() == 0


def test_suffix_query(spark, sf):
    """The registered query against counts of all 400-byte and 50-word windows."""
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passages"], r["text"]) for r in QUERIES["op8_suffix_array_dedup"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    want = zip(rows, brute_spans(raw, 400), brute_words(raw, 50))
    assert got == {r["doc_id"]: (*x[:3], hashlib.sha256(x[3]).hexdigest(), y[1], y[2].decode()) for r, x, y in want}


def test_suffix_segments(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    for unit, text in (("bytes", bytes(rng.choice(b"abc") for _ in range(500))), ("words", b" ".join(rng.choice([b"a", b"bc"]) for _ in range(500)))):
        suffix_dedup._powers.cache_clear()
        _, first, last = suffix_dedup.anchors_of(suffix_dedup.Line(text, unit), suffix_dedup.Cut(unit, 20))
        assert sorted(s for lo, hi in zip(first, last) for s in range(lo, hi + 1)) == list(range(500 - 19))
    suffix_dedup._powers.cache_clear()


def test_line(monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    for _ in range(300):
        t = "".join(rng.choice(["a", "bc", "é", " ", "\n", "\t ", "w" * 9]) for _ in range(rng.randrange(60))).encode() + b"x" * rng.choice([0, 0, 70_000])
        line, w = suffix_dedup.Line(t, "words"), t.split()
        assert line.size == len(w) and line.part(0, line.size) == b"".join(x + b" " for x in w)
        assert [t[s : s + len(x)] for s, x in zip(suffix_dedup.word_starts(np.frombuffer(t, np.uint8)), w)] == w
        if w:
            assert line.back(0, len(w)).split() == w[::-1] and len(set(zip(w, line.values().tolist()))) == len(set(w))


def test_key_bits(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    bits = common.KeyBits(keys, ["k"])
    rows = spark.range(3000).withColumnRenamed("id", "k").withColumn("x", F.lit("é"))
    on, off = ({r["k"] for r in bits.rows(rows, p).collect()} for p in (True, False))
    assert on >= set(range(0, 3000, 3)) and not on & off and len(on) + len(off) == 3000 and len(on) < 1500
    assert common.KeyBits(keys.limit(0), ["k"]).rows(rows, True).count() == 0


# Mixing


def test_sainte_lague():
    rng = np.random.default_rng(0)
    for _ in range(200):
        v, seats = rng.integers(0, 90, rng.integers(1, 9)).astype(float), int(rng.integers(0, 150))
        if not v.sum():
            continue
        want = np.zeros(len(v), int)
        for _ in range(seats):
            want[np.argmax(np.where(v > 0, v / (2 * want + 1), -1))] += 1
        got = mixing.sainte_lague(v, seats)
        assert got.sum() == seats
        assert np.allclose(sorted(v[v > 0] / (2 * want[v > 0] + 1)), sorted(v[v > 0] / (2 * got[v > 0] + 1)))
    assert mixing.sainte_lague(np.array([5.0, 1.0]), 10, np.array([3, 2])).tolist() == [3, 2]
    assert mixing.sainte_lague(np.array([]), 3).tolist() == []


def test_water_fill():
    t = mixing.water_fill(np.array([5.0, 2.0, 1.0]), np.array([10.0, 100.0, 100.0]), 70.0)
    assert np.allclose(t, [10, 40, 20])


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(200))), rng.choice(["b", "a", "é", None, "a", "a"])) for i in range(300)] + [(900, None, "a"), (901, "", None), (902, "x " * 5000, "a"), (903, "q", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("quota", F.lit(1))
    got = {r["doc_id"]: r for r in mixing.mix(df, block=16, shard_words=2000).collect()}
    size = {d: len(words(t)) for d, t, _ in rows}
    assert len(got) == len(rows) and all(got[d]["size"] == n for d, n in size.items())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got.values())
    by = Counter()
    for d, _, s in rows:
        by[s] += size[d]
    order = sorted((s for s in by if s is not None)) + [None]
    want = mixing.water_fill(np.resize(np.array([5.0, 2.0, 1.0]), len(order)), np.array([2.0 * by[s] for s in order]), 1.5 * sum(by.values()))
    for s, t in zip(order, want):
        mine = [got[d] for d, _, x in rows if x == s]
        assert all(abs(r["target"] - t) < 1e-6 and r["source_size"] == by[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 16 * (by[s] // 2000 + 4)  # a short last block in each shard
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7), block=16, shard_words=2000).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}
    texts = Counter()
    for r in mixing.mixed_texts(df, block=16, shard_words=2000).collect():
        texts[r["doc_id"]] += len(words(r["text"]))
    assert {d: n for d, n in texts.items() if n} == {d: r["taken"] for d, r in got.items() if r["taken"]}
    assert mixing.mix(df.limit(0)).count() == 0


# Packing


def test_plan():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 60, 900, 9000):
        c = np.bincount(np.minimum(64, rng.geometric(0.07, n)), minlength=65)
        used = np.zeros(65, int)
        total = 0
        for pattern, times in packing.plan(c):
            assert sum(pattern) <= 64 and times > 0
            total += times
            for x in pattern:
                used[x] += times
        assert (used == c).all()
        assert total <= -(-int((c * np.arange(65)).sum()) // 64) * 1.03 + 1


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    texts = [None, "", "Hello  WORLD it's x<|endoftext|>y", "é é a\x1cb", "İi ΣΑΣ 12a3\x85z", "日本 語", "w" * 3000, "one two three " * 3000, "same", "same", "a b c"]
    rows = [*enumerate(texts), (8, "same"), (None, "null")]
    got = packing.pack(spark.createDataFrame(rows, DOC).withColumn("length", F.lit(1)), TOKENIZER, size=256).collect()
    want = Counter()
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), 256)):
            want[d, i, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    ids = packing.pieces(spark.createDataFrame(rows, DOC), TOKENIZER, size=256, with_ids=True).where("doc_id = 7").orderBy("piece").collect()
    assert b"".join(r["ids"] for r in ids)[:-4] == np.array(tok.encode(texts[7], add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.pack(spark.createDataFrame([], DOC), TOKENIZER).count() == 0


# Quality


def test_quality(spark, sf):
    import pandas as pd

    r = QUERIES["op5_quality_classifier"](spark, sf).toPandas()
    d = pd.read_parquet(f"{sf}/documents.parquet")
    assert len(r) == len(d) and r["score"].between(0, 1).all() and ((r["score"] >= 0.5) == (r["predicted"] == 1)).all()
    assert (r.set_index("doc_id")["held_out"] == pd.Series([zlib.crc32(str(i).encode()) % 3 == 1 for i in d.doc_id], index=d.doc_id)).all()
    m = r.merge(pd.read_parquet(f"{sf}/labels.parquet"))
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good words here"), (3, "good words here")], DOC).withColumn("lang", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(3, 1), (1, None)], "doc_id long, quality int")
    for labels in (none, one):
        s = [r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()]
        assert len(s) == 4 and all(0 <= x <= 1 for x in s)
    assert quality.score(docs.limit(0), quality.fit(docs, one)).count() == 0


# Chat


def test_chat_oracle(spark, duck, sf):
    got = QUERIES["op6_chat_formatting"](spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = duck.execute(ORACLES["op6_chat_formatting"]).df().sort_values("conv_id").reset_index(drop=True)
    assert len(got) == len(want) and all((got[c] == want[c]).all() for c in want.columns)


def test_chat_events(spark):
    log = [(1, 1, 7, 0, "start", "user"), (1, 1, 7, 1, "delta", "hel"), (1, 1, 7, 2, "delta", "lo"), (1, 2, 3, 4, "delta", "bad"), (1, 2, 3, 5, "regenerate", None), (1, 2, 3, 7, "delta", "od"), (1, 2, 3, 6, "delta", "go"), (1, 2, 3, 0, "start", "assistant"), (1, 1, 7, 8, "edit", "hi"), (1, 1, 7, 9, "delta", "!"), (1, 1, 7, 9, "seen", "x")]
    log += [(2, None, None, 1, "delta", "no role"), (2, 5, 1, 0, "start", "b"), (2, 5, 2, 0, "start", "a"), (2, 5, 2, 1, "edit", None), (2, 6, 1, 0, "regenerate", None)]
    e = spark.createDataFrame(log, "conv_id long, at long, message long, seq long, event string, text string").withColumn("role", F.lit("clash"))
    r = {x["conv_id"]: x for x in chat.format_chats(e).collect()}
    turns = {c: [(t["role"], t["text"]) for t in x["turns"]] for c, x in r.items()}
    assert turns == {1: [("user", "hi!"), ("assistant", "good")], 2: [("", "no role"), ("a", ""), ("b", ""), ("", "")]}
    assert r[1]["loss_text"] == "good" and r[2]["loss_text"] == ""
    assert chat.format_chats(e.limit(0)).count() == 0


def test_chat_log(spark):
    """The query's own log really streams, edits and regenerates."""
    t = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defg")], "conv_id long, turn long, role string, text string")
    kinds = Counter(r["event"] for r in chat.turns_as_events(t).collect())
    assert kinds == {"start": 2, "delta": 5, "edit": 1, "regenerate": 1}


def test_chat_long(spark):
    """One conversation of thousands of turns and one very long text."""
    t = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(6000)] + [(2, 0, "assistant", "<é" * 500_000)], "conv_id long, turn long, role string, text string")
    r = {x["conv_id"]: x for x in chat.format_chats(chat.turns_as_events(t)).collect()}
    assert [x["text"] for x in r[1]["turns"]] == [f"t{i}" for i in range(6000)] and r[2]["loss_text"] == "<é" * 500_000


def test_chat_round_trip(spark):
    rng = random.Random(8)
    parts = ["</s>", "<s>[INST]", "[/INST]", "&lt;", "&amp;", "&", "<", "[", "\n", "é", " ", "&lb;", "&nl;"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
    turns = [(c, t, rng.choice(["user", "assistant", text()]), rng.choice([None, text()])) for c in range(40) for t in range(3)]
    turns += [(50, 0, None, None), (50, 0, None, None), (50, 0, "a", "y"), (50, 0, "a", "x"), (50, None, "b", "x"), (None, None, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.format_chats(chat.turns_as_events(df)).collect()}
    want = {}
    for c, t, r, x in sorted(turns, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == want


# Token counts


def test_automaton():
    auto, alphabet = token_counts.automaton(TOKENIZER), token_counts.byte_alphabet()
    import json

    with open(TOKENIZER) as f:
        vocab = {token_counts.symbols_of(t, "</w>", alphabet) for t in json.load(f)["model"]["vocab"] if t not in ("</w>", "<|startoftext|>", "<|endoftext|>")}
    longest = max(map(len, vocab))

    def greedy(word):
        s, at, n = (*word, token_counts.END), 0, 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in vocab)
            n += 1
        return n

    rng = random.Random(9)
    ws = [bytes(rng.choice(b"abcdehinorst") for _ in range(rng.randrange(1, 25))) for _ in range(800)] + ["größer".encode(), "日本語".encode(), b"x" * 500]
    assert auto.counts(ws).tolist() == [greedy(w) for w in ws]
    tiny = token_counts.Automaton([(1, 2, 3), (1,), (2, 256), (2,), (256,)])
    assert tiny.counts([bytes([1, 2]), bytes([1, 2, 3]), bytes([3]), b""]).tolist() == [2, 2, -1, 0]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello it's x<|endoftext|>"), (3, "Hello it's x<|endoftext|>")], DOC).withColumn("n_tokens", F.lit(0))
    rows = sorted((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(df, TOKENIZER).collect())
    assert rows == [(1, 0, 0), (2, 0, 0), (3, 3, 5), (3, 3, 5)]


# Winnowing


def brute_winnow(t, k=5, w=16):
    low = (1 << 26) - 1
    ws = words(t)
    if not ws:
        return []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ws]

    def gram(part):
        seed = 42
        for x in part:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    g = [gram(h[i : i + k]) & ~low | low - i for i in range(max(1, len(h) - k + 1))]
    out = []
    for i in range(max(1, len(g) - w + 1)):
        m = min(g[i : i + w])
        if m not in out:
            out.append(m)
    return out


def brute_edited(rows):
    rows = sorted(rows, key=lambda r: (-r[0]))
    like = lambda a, b: 1.0 if not {*a, *b} else len({x >> 26 for x in a} & {x >> 26 for x in b}) / len({x >> 26 for x in a} | {x >> 26 for x in b})
    text = lambda f: " ".join(f"{x & (1 << 64) - 1:016X}" for x in f)
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = brute_winnow(t), brute_winnow(edited), brute_winnow(nxt)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c))
    return out


def test_winnowing(spark):
    rng = random.Random(10)
    rows = [(i * 7 - 50, x) for i, x in enumerate(["a b c", "", None, " lead  tab\tx\x0by ", "é ü " * 40, "word", " ".join(rng.choice("abcd") for _ in range(300)), "日本 語 " * 9])]
    rows += [(1000 + i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(120)))) for i in range(60)]
    for part in (rows, rows[:1]):
        df = spark.createDataFrame(part, DOC).withColumn("entries", F.lit(1))
        assert {r[0]: tuple(r[1:]) for r in winnowing.edited_fingerprints(df).collect()} == brute_edited(part)
    same = winnowing.edited_fingerprints(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y")], DOC)).collect()
    assert len(same) == 3 and len({r["fingerprint"] for r in same}) == 1
    assert winnowing.edited_fingerprints(spark.createDataFrame([], DOC)).count() == 0


# Pages


def test_html_lines():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">Cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>Hello <b>wor</b>ld<br>x&nbsp;y<p>un&lt;closed
    <div class="ad">Buy</div><table><tr><td>a<td>b</table><form>sign</form><section id="comments"><p>nice</section></article></main><aside>side</aside><footer>f</footer>"""
    assert [t for t, p in html_text.lines_of(page) if p == html_text.OWN] == ["Title & more", "Hello world", "x y", "un<closed", "a", "b"]
    assert html_text.lines_of(None) == [] and html_text.lines_of("a & b < c") == [("a & b < c", html_text.OPEN)]


def test_shared_lines():
    rng = random.Random(11)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(500):
        a, b = ([rng.randrange(rng.choice([2, 9])) for _ in range(rng.randrange(14))] for _ in range(2))
        for f in (html_text.shared_lines, html_text._shared_bits):
            x, it = [v for v, k in zip(a, f(a, b)) if k], iter(b)
            assert len(x) == longest(a, b) and all(c in it for c in x)


def test_differencing(spark):
    frame = lambda body: f"<body><div>Site title</div><div>{body}</div><p>All rights reserved</p></body>"
    rows = [(1, "http://h.com/a/1", frame("first")), (2, "http://h.com/a/2", frame("second")), (3, "http://x.com/", frame("alone")), (4, None, None), (5, "http://h.com/a/1", frame("first")), (5, "http://h.com/a/1", frame("first"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect())
    assert got[2, "second"] == 1 and got[3, "Site title alone All rights reserved"] == 1 and got[4, ""] == 1 and sum(got.values()) == 6
    assert html_text.extract_text(df.limit(0)).count() == 0


def brute_pages(rows):
    """Whole sites in one list, sorted, each page differenced with the neighbour of the longest shared path."""
    cut = re.compile(r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*))?([^?#]*)")
    keyed = sorted((cut.match(u or "")[1] or "", cut.match(u or "")[2], u or "", str(p).rjust(20), html_text.lines_of(h)) for p, u, h in rows)
    out = Counter()
    for i, (host, path, _, p, lines) in enumerate(keyed):
        near = [keyed[j] for j in (i - 1, i + 1) if 0 <= j < len(keyed) and keyed[j][0] == host]
        near.sort(key=lambda x: -len(os.path.commonprefix([path, x[1]])))
        shared = [False] * len(lines)
        for x in near:
            on = html_text.shared_lines(html_text._line_hashes([t for t, _ in lines]), html_text._line_hashes([t for t, _ in x[4]]))
            if not all(on):
                shared = on
                break
        article = any(k == html_text.OWN for _, k in lines)
        out[int(p), " ".join(t for (t, k), s in zip(lines, shared) if k == html_text.OWN or (k == html_text.OPEN and not article and not s))] += 1
    return out


def test_html_brute(spark, sf):
    """The registered query against one sorted list, also with a page in each range and with a hot host."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute_pages(rows)
    assert Counter((r["page_id"], r["text"]) for r in QUERIES["op10_html_extraction"](spark, sf).collect()) == want
    rng = random.Random(13)
    frame = lambda i: f"<div>Site {i % 3}</div><div>own {i}</div><p>All rights {i % 2}</p>"
    hot = [(i, f"http://hot.com/{rng.choice(['a', 'b/c', ''])}/article-{rng.randrange(9)}?q={rng.randrange(3)}", frame(i)) for i in range(300)]
    hot += [(1000 + i, "http://hot.com/same", frame(i)) for i in range(50)] + [(2000, "http://big.com/", "<p>x</p>" * 60_000), (2001, "http://big.com/2", "<p>x</p><p>y</p>")]
    df = spark.createDataFrame(hot, "page_id long, url string, html string")
    assert Counter((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect()) == brute_pages(hot)


# Embeddings


def test_near_duplicates(spark):
    rng = np.random.default_rng(12)
    c = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.12 * rng.normal(size=c.shape) for _ in range(12)] + [rng.normal(size=(300, 16)), c[:5], c[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rep", F.lit(1))
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = union(n, np.argwhere(near).tolist())
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(df, shard_bytes=300 * 8 * 16, block_rows=400, chunk_rows=150).collect()}
    assert len(got) == n + 6 and all(got[i] == (0, i) for i in range(n, n + 6))
    links = sum(got[i][0] for i in range(n))
    assert 0.97 * near.sum() <= links <= near.sum()
    assert np.mean([got[i][1] == comp[i] for i in range(n)]) > 0.97
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>")
    rows = sorted((r["id"] or -1, r["n_links"], r["component_id"] or -1) for r in hnsw.near_duplicates(odd).collect())
    assert rows == [(-1, 0, -1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_graph_round_trip():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    h = hnsw.Graph.from_bytes(g.to_bytes())
    a, b = g.search(x[:50], 32), h.search(x[:50], 32)
    assert (a[0] == b[0]).all() and (g.perm[a[0][:, 0]] == np.arange(50)).mean() > 0.95


# Pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        from kgloom.llm.common import materialize

        docs = materialize(docs)
        sizes.append(docs.count())
        if stage is not corpus_pipeline.packing:
            assert docs.columns == first.columns
    assert 0 < sizes[1] <= sizes[0] <= first.count() and sizes[2] == sizes[1]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert sum(r["length"] for r in docs.collect()) == sum(r["length"] for r in corpus_pipeline.run(spark, sf).collect())
