"""Conversation trie, line dedup and fill-in-the-middle against brute force on nulls, ties, repeated rows, hot groups and
long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import fill_middle, line_dedup, prefix_trie
from kgloom.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Conversation prefix trie


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(members[p]) - 1) * words + sum(below[k][1] for k in kids[p])
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved)
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p], sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))))
        for p, m in members.items()
    }


def brute_branched(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie_rows(df):
    figures = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = df.collect()
    found = {(r["conv_id"], r["depth"]): tuple(r[c] for c in figures) for r in rows}
    assert len(found) == len(rows)
    return found


def made_convs(rng):
    convs = {}
    for c in range(400):
        n = rng.choice([0, 1, 2, 2, 3, 5, 8])
        convs[c * 3] = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "c c c", ""])) for _ in range(n)]
    for c in range(2001, 2150):  # a hot group of copies
        convs[c] = [("user", "hot one"), ("assistant", "same"), ("user", "x y z")]
    for c in range(3001, 3100):  # hot first turns
        convs[c] = [("user", "hot one"), ("assistant", f"answer {c}")]
    long = [("user", f"turn {i}") for i in range(150)]
    for c in range(4001, 4020):
        convs[c] = long[: 150 - c % 4] + [("user", str(c % 5))]
    return convs


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_trie(spark, partitions, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    convs = made_convs(random.Random(partitions))
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    made = prefix_trie.conversations(spark.createDataFrame(rows, TURNS))
    empty = [(c, []) for c, t in convs.items() if not t]
    made = made.unionByName(spark.createDataFrame(empty, made.schema)) if empty else made
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert trie_rows(prefix_trie.prefix_trie(made)) == brute_trie(convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_branched_conversations(spark):
    rows = [(5, None, None, "first"), (5, 2, "user", None), (5, 1, "a", "b"), (5, 1, "a", "b"), (None, 1, "user", "no conversation"), (0, 0, "s", "x"), (0, 1, "t", "y"), (0, 2, "u", "z"), (7, 0, "v", "w"), (21, 0, "q", "q"), (21, 1, "r", "r"), (-3, 0, "n", "n")]
    df = spark.createDataFrame(rows, TURNS).withColumn("h1", F.lit("clash")).withColumn("path", F.lit(1))
    convs = {5: [("", "first"), ("a", "b"), ("a", "b"), ("user", "")], 0: [("s", "x"), ("t", "y"), ("u", "z")], 7: [("v", "w")], 21: [("q", "q"), ("r", "r")], -3: [("n", "n")]}
    made = prefix_trie.conversations(df)
    assert trie_rows(prefix_trie.prefix_trie(made)) == brute_trie(convs)
    del convs[-3]  # Python's remainder differs for negative numbers
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.branched(made.where("conv_id >= 0")))) == brute_trie(brute_branched(convs))
    assert prefix_trie.prefix_trie(made.limit(0)).count() == 0
    texts = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.last_turns(prefix_trie.prefix_trie(made), df).collect()}
    assert texts[5, 1] == ("", "first") and texts[5, 4] == ("user", "") and texts[-3, 0] == (None, None)


# Line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    held = defaultdict(list)
    for i, lines in docs:
        for k in {key(x) for x in lines}:
            if len(k) >= min_chars:
                held[k].append(i)
    order = lambda i: (i is not None, i or 0)
    keeper = {k: max(v, key=order) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, lines in docs:
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def made_lines(rng):
    common = ["É" * 39 + "x", "e" * 40, "E" * 40, "ß" + "Line " * 10, "short", "\t " + "padded line, " * 4 + " \r", "y" * 39, "İ" + "dotted " * 8]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) for _ in range(rng.randrange(4))] + [f"own {rng.randrange(40)} " + "z" * 40 for _ in range(rng.randrange(3))]
        rng.shuffle(lines)
        rows.append((i, rng.choice(["\n", "\n", "\n\n"]).join(lines) + rng.choice(["", "\n"])))
    rows += [(None, "e" * 40), (None, "null ids " * 9), (None, "null ids " * 9), (500, None), (501, ""), (502, "\n\n"), (503, "e" * 40 + "\nE" + "e" * 39), (503, "e" * 40), (-4, "e" * 40)]
    rows += [(None, "null ids " * 9)] * 4 + [(90, "again and again and again and again and again")] * 6
    rows.append((700, "\n".join(["q" * 50] * 3000 + [f"{i} " * 20 for i in range(3000)])))
    return rows + [(701 + i, "q" * 50) for i in range(3)]


@pytest.mark.parametrize("batches,fanout,hot", [(1, 2, 0.001), (4, 2, 0.5), (5, 3, 0.001)])
def test_line_dedup(spark, monkeypatch, batches, fanout, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = made_lines(random.Random(batches))
    df = spark.createDataFrame(rows, DOC).withColumn("n_lines", F.lit("clash")).withColumn("keys", F.lit(1)).withColumn("keeper", F.lit(2))
    got = line_dedup.line_dedup(df, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "keys", "keeper", "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_growing_corpus(spark):
    a, b, c = "first line " * 5, "second line " * 5, "third line " * 5
    runs = line_dedup.LineRuns(fanout=2)
    days = [[(1, a), (2, f"{a}\n{b}")], [(3, f"{b}\n{c}"), (4, f"{c}\nshort")], [(5, a), (6, "short")], [(7, f"{c}\n{b}\nnew")], [(None, "no id " * 9), (None, "no id " * 9)]]
    want = [{1: "", 2: f"{a}\n{b}"}, {3: "", 4: f"{c}\nshort"}, {5: "", 6: "short"}, {7: "new"}, {None: "no id " * 9}]
    for rows, kept in zip(days, want, strict=True):
        assert {r["doc_id"]: r["text"] for r in line_dedup.drop_seen(spark.createDataFrame(rows, DOC), runs).collect()} == kept
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    seen = runs.levels[0][0]
    plan = runs.unseen(seen.select("h1", "h2"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan  # runs are merged as they lie


# Fill-in-the-middle


def brute_middle(i, text, seed=7, unit="lines"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    h = sha(f"{seed}:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["lines", "chars"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(4)
    alphabet = ["a", "b", "\n", "\n", "é", "ß", "漢", "字", "🙂", "\r", " ", "<", "P", ">", "\x00"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "no id\nline"), (None, None), (401, None), (402, ""), (403, "a <S> b"), (404, "<M"), (405, "\n" * 9), (405, "\n" * 9), (406, "é" * 300_000 + "\n" + "x" * 300_000)]
    df = spark.createDataFrame(rows, DOC).withColumn("form", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("lang", F.lit("de"))
    got = fill_middle.fill_in_middle(df, unit=unit).withColumn("back", fill_middle.restored())
    assert got.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got.collect())
    assert found == Counter((i, t, *brute_middle(i, t, unit=unit)) for i, t in rows)
    assert got.where(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    assert {r["form"] for r in fill_middle.fill_in_middle(df, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(df, unit="words")


def test_char_index():
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice(["a", "b", "é", "漢", "🙂"]) for _ in range(rng.randrange(40)))
        index = fill_middle.CharIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        cuts = np.array([len(text[:i].encode()) for i in points])
        assert index.n_points == len(text)
        assert (index.to_bytes(points) == cuts).all() and (index.to_points(cuts) == points).all()
    assert len(fill_middle.CharIndex(np.frombuffer(b"x" * 1000, np.uint8)).at) == 0


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_in_middle", "op13_conversation_trie"])
def test_query(spark, duck, sf, name):
    from test_catalog import rows

    assert rows(QUERIES[name](spark, sf).toArrow()) == rows(duck.execute(ORACLES[name]).to_arrow_table())
