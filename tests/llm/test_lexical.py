"""Ranked search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from llm.conftest import LOWER

from serupa.llm import lexical_search as L


def terms_of(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, texts, k=20):
    """For each query (rank, id, score) from the contract's formula."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in docs) if t]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for text in texts:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // words
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if total > 0:
                found.append((-total, i is None, i or 0, i))
        found.sort(key=lambda r: r[:3])
        out.append([(rank + 1, r[3], -r[0]) for rank, r in enumerate(found[:k])])
    return out


def results(found, queries):
    got = {}
    for r in found.collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return [sorted(got.get(i, []), key=lambda r: r[0]) for i, _ in queries]


def check(spark, docs, texts, k=20, extra=""):
    schema = "doc_id long, text string, rank string, score string, item_id string, id string, query string, digest string"
    table = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in docs], schema).repartition(3)
    queries = list(enumerate(texts))
    asked = spark.createDataFrame([(i, t, "r", "s") for i, t in queries], "item_id long, text string, doc_id string, rank string")
    found = L.ranked(table, asked, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert results(found, queries) == brute(docs, texts, k)


def made(seed, n, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_ranked_equals_brute_force(spark, odd_texts, monkeypatch, small):
    if small:  # many blocks, parts of queries and searches
        monkeypatch.setattr(L, "BLOCK_DOCS", 8)
        monkeypatch.setattr(L, "TOGETHER", 30)
        monkeypatch.setattr(L, "SHIPPED_BYTES", 2000)
        monkeypatch.setattr(L, "HELD_TERMS", 50)
        monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    texts = made(1, 150) + odd_texts + ["W1 w1, W2!"] * 5
    docs = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, texts[9]), (None, texts[9]), (None, "rare word"), (-5, texts[11])]
    check(spark, docs, made(2, 12, 20) + ["rare word", "", None, "...", "nowhere", "w1 w1 w1 w2", "the quick fox " * 50, texts[3]])


def test_many_copies_and_ties(spark, monkeypatch):
    """Copies in a number beyond k, texts that tie, and a query that meets all of them."""
    monkeypatch.setattr(L, "BLOCK_DOCS", 16)
    docs = [(1000 - i, "a very common line") for i in range(200)] + [(i, f"a very common line {i % 3}") for i in range(150)] + [(2000 + i, f"other words {i}") for i in range(100)]
    check(spark, docs, ["common line", "a very common line 1", "other words 7", "line 2"], k=5)


def test_long_texts_and_counts(spark):
    docs = [(0, "x " * 100_000 + "y"), (1, "x y"), (2, "y " * 9 + "x"), (3, " ".join(f"t{i}" for i in range(60_000))), (4, "z")]
    check(spark, docs, ["x", "y", "t5 t59999 x", "z z z"], k=2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (None, "b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert L.ranked(none, asked).collect() == []
    assert L.ranked(docs, asked.limit(0)).collect() == []
    assert sorted((r.item_id or 0, r.rank, r.doc_id) for r in L.ranked(docs, asked).collect()) == [(0, 1, 1), (1, 1, 1)]


def test_bounds_hold_and_exclude():
    """No bound is below the exact score, and most documents are excluded by it."""
    texts = [t.encode() for t in made(4, 3000)]
    counts = [Counter(L.words_of(t)) for t in texts]
    lengths = [len(L.words_of(t)) for t in texts]
    df = dict(Counter(t for c in counts for t in c))
    queries = L.Queries.build([t.encode() for t in made(5, 20, 15)], df, len(texts), sum(lengths))
    blocks, rows = L._Blocks(), []
    for i, (c, n) in enumerate(zip(counts, lengths, strict=True)):
        rows += [r for r in [blocks.add(c, n, i, md5(texts[i]).digest())] if r]
    rows += [blocks.row(s) for s in list(blocks.held)]
    exact = np.array([[L.score(c, n, queries.weights(q), len(texts), sum(lengths)) for c, n in zip(counts, lengths, strict=True)] for q in range(20)])
    bound = np.zeros(exact.shape)
    for row in rows:
        ids, _, _ = L._documents(row)
        for q, b in queries.bounds(row):
            bound[q, ids] = b
    assert (bound >= exact).all()
    floor = np.sort(exact, axis=1)[:, -20][:, None]
    assert (bound >= floor).mean() < 0.06  # of 3,000 documents of few and mostly frequent words
