"""Token counts of greedy word pieces by a linear longest-match automaton.

A word, the run of characters between white space, is preceded by a mark and cut from the left into the longest
pieces of a vocabulary. The vocabulary's trie gets failure links: at a node without a suitable edge, the pieces
that greedy matching would take are popped, and the link leads to the node of what is left. Only the numbers of
popped pieces are kept, precomputed per node, so a word of n bytes takes at most 2n steps and no piece is built.

A byte that no piece begins with is a token of its own. The vocabulary is a byte-level one in JSON
("model": {"vocab": {piece: id}}), whose pieces that begin a word carry the mark; its path is a parameter.
The vocabulary file is read by the driver and shipped to the tasks; files beyond ``VOCABULARY_BYTES`` are refused.

Defined results: null, empty and white-space texts have no words and no tokens. Repeated rows get equal counts. An
empty table gives no rows. Texts are counted whole; a word of any length is one walk.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from serupa.llm.batches import map_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_BYTES = 64 << 20
REMEMBERED = 1 << 18  # words whose counts a task keeps
MARK = 0x20  # the byte before a word's first


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    file = Path(path)
    if file.stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    known, pieces = _byte_of(), json.loads(file.read_text("utf-8"))["model"]["vocab"]
    return sorted(bytes(known[c] for c in p) for p in pieces if all(c in known for c in p))


class Automaton:
    """Edges by (node << 8 | byte), and per node the failure link and the number of pieces popped on the way there."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.edges: dict[int, int] = {}
        parent, byte, ends = [0], [0], [False]
        for piece in [*(bytes([b]) for b in range(256)), *filter(None, pieces)]:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in self.edges:
                    self.edges[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    ends.append(False)
                node = self.edges[key]
            ends[node] = True
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # parents come first
            depth[node] = depth[parent[node]] + 1
        self.link, self.popped = [0] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if ends[node]:
                self.popped[node] = 1
                continue
            at, popped = self.link[parent[node]], self.popped[parent[node]]
            while at << 8 | byte[node] not in self.edges:  # the root has every byte
                at, popped = self.link[at], popped + self.popped[at]
            self.link[node], self.popped[node] = self.edges[at << 8 | byte[node]], popped

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = edges[MARK]
        tokens = 0
        for b in word:
            while (key := node << 8 | b) not in edges:
                tokens += popped[node]
                node = link[node]
            node = edges[key]
        while node:
            tokens += popped[node]
            node = link[node]
        return tokens


class _Counts(dict):
    """Counts of words met before; starts anew when it holds ``REMEMBERED`` words."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.automaton.count(word)
        return n


@lru_cache(2)
def _automaton(pieces: tuple[bytes, ...]) -> Automaton:
    """Built once per Python worker."""
    return Automaton(list(pieces))


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", pieces: list[bytes] | None = None) -> DataFrame:
    """``keep`` columns with n_words and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(read_vocabulary() if pieces is None else pieces))

    def work():
        counts = _Counts(_automaton(shared.value))

        def fn(texts):
            words = [t.split() if t else [] for t in texts]
            return [np.array([len(w) for w in words], np.int64), np.array([sum(map(counts.__getitem__, w)) for w in words], np.int64)]

        return fn

    return map_text(docs, "n_words long, n_tokens long", work, keep, text)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
