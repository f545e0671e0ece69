"""Greedy longest-match token counts in linear time.

A trie of the vocabulary gets failure links as in a longest-match automaton: when a node has no child for the next
byte, its link leads to the node that remains after the tokens of its string's greedy tokenization are popped, and the
number of tokens popped on the way is precomputed, so counts come from adding numbers; no piece is ever built. Words
of a batch run in lock-step: one vector of states steps through all of them byte by byte.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose counts a worker remembers; it starts anew beyond.
CACHE = 1_000_000
#: How the vocabulary's texts are cut into words before greedy matching.
SPLIT = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = frozenset({"<|startoftext|>", "<|endoftext|>"})
END = 256  # the symbol that ends a word
DEAD = -1


class Automaton:
    """vocabulary: tokens as tuples of symbols (0 to 255, then END where the token ends a word). Tokens in free are
    matched like others but count nothing."""

    def __init__(self, vocabulary: list[tuple[int, ...]], free: tuple[tuple[int, ...], ...] = ()) -> None:
        kids: list[dict[int, int]] = [{}]
        token = [False]
        unpaid = set()
        for t in (*vocabulary, *free):
            at = 0
            for c in t:
                nxt = kids[at].get(c)
                if nxt is None:
                    nxt = kids[at][c] = len(kids)
                    kids.append({})
                    token.append(False)
                at = nxt
            token[at] = True
            if t in free:
                unpaid.add(at)
        link, popped = [DEAD] * len(kids), [0] * len(kids)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in kids[u].items():
                queue.append(v)
                if token[v]:
                    link[v], popped[v] = 0, int(v not in unpaid)
                else:  # pop what the parent's string pops, then go on with c
                    z, n = link[u], popped[u]
                    while z != DEAD and c not in kids[z]:
                        n += popped[z]
                        z = link[z]
                    if z != DEAD:
                        link[v], popped[v] = kids[z][c], n
        self.link, self.popped = np.array(link), np.array(popped)
        keys = np.array([u * 512 + c for u, k in enumerate(kids) for c in k], np.int64)
        to = np.array([v for k in kids for v in k.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, END appended; -1 if the vocabulary can't spell it; 0 for an empty word."""
        total = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state = np.zeros(len(words), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            last = step == size[live]
            sym = np.full(len(live), END, np.int64)
            sym[~last] = flat[begin[live[~last]] + step]
            self._advance(live, sym, state, total)
            done = live[last]
            self._finish(done, state, total)
            live = live[~last & (total[live] >= 0)]
            step += 1
        return total

    def _advance(self, which: np.ndarray, sym: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        while len(which):
            want = state[which] * 512 + sym
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            state[which[hit]] = self.to[at[hit]]
            which, sym = which[~hit], sym[~hit]
            total[which] += self.popped[state[which]]
            state[which] = self.link[state[which]]
            lost = state[which] == DEAD
            total[which[lost]] = -1
            which, sym = which[~lost], sym[~lost]

    def _finish(self, which: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        which = which[total[which] >= 0]
        while len(which):
            which = which[state[which] != 0]
            total[which] += self.popped[state[which]]
            state[which] = self.link[state[which]]
            lost = state[which] == DEAD
            total[which[lost]] = -1
            which = which[~lost]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's printable ones stand for
    themselves, the rest take code points from 256 in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def symbols_of(token: str, suffix: str, alphabet: dict[str, int]) -> tuple[int, ...]:
    ends = token.endswith(suffix)
    return (*(alphabet[c] for c in (token[: -len(suffix)] if ends else token)), *([END] if ends else []))


@cache
def automaton(path: str) -> Automaton:
    """A word's last piece may be one that ends words or, if longer, one that doesn't: its end is then a free token."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special, suffix, alphabet = {t["content"] for t in model["added_tokens"]}, model["model"]["end_of_word_suffix"], byte_alphabet()
    return Automaton([symbols_of(t, suffix, alphabet) for t in model["model"]["vocab"] if t not in special and t != suffix], free=((END,),))


class Counter:
    def __init__(self, auto: Automaton) -> None:
        self.auto, self.seen = auto, {}

    def add(self, chunks: set[str]) -> None:
        """Counts of white-space-free chunks: each is normalized and cut into words."""
        new = [c for c in chunks if c not in self.seen]
        words, owner = [], []
        sums = [0] * len(new)
        for i, c in enumerate(new):
            for w in SPLIT.findall(unicodedata.normalize("NFC", c)):
                if w in SPECIAL:
                    sums[i] += 1
                else:
                    words.append(w.lower().encode("utf-8", "surrogatepass"))
                    owner.append(i)
        if words:
            got = self.auto.counts(words)
            np.add.at(total := np.zeros(len(new), np.int64), owner, np.where(got < 0, 1, got))  # a word that can't be spelt is one unknown token
            sums = (total + np.array(sums)).tolist()
        self.seen.update(zip(new, sums, strict=True))


@cache
def counter_of(path: str) -> Counter:
    """One for each worker process, so that its tasks share what is remembered."""
    return Counter(automaton(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) per row: white-space-free chunks and greedy longest-match tokens of the whole text;
    0 for null and empty texts. vocabulary: path of a word-end vocabulary that every executor has."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for b in batches:
            n_words, n_tokens = [], []
            texts = [(t or "").split() for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                chunks = set().union(*part)
                if len(counter.seen) + len(chunks) > CACHE:
                    counter.seen.clear()
                counter.add(chunks)
                seen = counter.seen
                n_words += map(len, part)
                n_tokens += [sum([seen[c] for c in t]) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_tokens long")
