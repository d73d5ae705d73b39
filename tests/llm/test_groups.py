"""Source mix, near duplicates, components and vector search against plain brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SMALL
from llm.conftest import LOWER

from serupa.llm import one_bit_search, simhash, source_mix
from serupa.llm.components import components
from serupa.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations"


def cells(rows):
    def cell(x):
        return None if x is None else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert cells(got.select(*columns).collect()) == cells(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def water_filled(sizes):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def check_mix(rows, texts, near=0.02):
    size_of = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by_source = {}
    for i, (source, text) in enumerate(texts):
        by_source.setdefault(source, []).append((i, size_of(text)))
    sizes = {s: sum(n for _, n in v) for s, v in by_source.items()}
    target = water_filled(sizes)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for source, members in by_source.items():
        taken = 0
        for i, n in members:
            for r in got[i]:
                assert r["size"] == n and r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6 * max(1, target[source])
                assert 0 <= r.taken <= 3 * n
            taken += got[i][0].taken
        assert abs(taken - target[source]) <= max(2, near * target[source]), (source, taken, target[source])
    return got


@pytest.mark.parametrize("shard_docs", [3, 20, 1000])
def test_mix(spark, shard_docs):
    r = random.Random(shard_docs)
    texts = [(r.choice(["hot", "hot", "hot", "b", "é", "z", None, "tiny"]), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 90)))) for _ in range(300)]
    texts += [("tiny2", "one two three"), ("void", ""), ("void", None), ("void", "\t \n"), ("long", "word " * 50_000)]
    df = spark.createDataFrame([(i, s, t, 1, "x") for i, (s, t) in enumerate(texts)], "doc_id long, source string, text string, size int, rank string")
    first = check_mix(source_mix.mix(df, ["doc_id"], shard_docs=shard_docs).collect(), texts)
    again = check_mix(source_mix.mix(df.repartition(7), ["doc_id"], shard_docs=shard_docs).collect(), texts)
    assert {i: x[0].taken for i, x in first.items()} == {i: x[0].taken for i, x in again.items()}


def test_mix_of_little(spark):
    schema = "doc_id long, source string, text string"
    assert source_mix.mix(spark.createDataFrame([], schema), ["doc_id"]).count() == 0
    rows = source_mix.mix(spark.createDataFrame([(None, None, None), (1, "a", ""), (1, "a", "")], schema), ["doc_id"]).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_apportion_by_highest_quotients(spark, seats):
    r = random.Random(seats)
    parties = [(g, i, float(r.choice([0, 1, 5, 5, 90, 1000, 3.7]))) for g in (1, 2) for i in range(30)]
    df = spark.createDataFrame([(*p, seats) for p in parties], "g int, i int, v double, seats long")
    got = {(x.g, x.i): x.quota for x in source_mix.apportion(df, "v", "seats", ["i"], ["g"]).collect()}
    for g in (1, 2):
        mine = [(i, v) for h, i, v in parties if h == g]
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in mine if v for k in range(seats)))[:seats]
        for i, _ in mine:
            assert got[g, i] == sum(j == i for _, j in quotients)


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(prints):
    """Smallest index of each component."""
    v, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(v))]


def near_copies(n=120):
    r = random.Random(1)
    base = [f"{r.randint(0, 99)}w" for _ in range(400)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [simhash.TILE, 10])
def test_near_duplicates(spark, docs, odd_texts, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    small = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = odd_texts + near_copies() + small + ["copy of one text many times"] * 60
    rows = simhash.near_duplicates(docs(texts, repeat=[14, 15]), ["doc_id"]).collect()
    prints = [fingerprint(t) for t in texts]
    roots = linked(prints)
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r.fingerprint % 2**64, r.component_id) == (prints[r.doc_id], roots[r.doc_id])


def test_signatures_find_every_distance_up_to_four(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, 60, np.uint64)
    flips = [base] + [base ^ np.array([sum(1 << int(b) for b in r.choice(64, k, replace=False)) for _ in base], np.uint64) for k in (1, 2, 3, 4, 5)]
    prints = np.unique(np.concatenate(flips))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    found = {x.node: x.root for x in components(simhash.near_links(df)).collect()}
    signed = prints.view(np.int64).tolist()
    classes = {}
    for i, root in enumerate(linked(prints.tolist())):
        classes.setdefault(root, set()).add(signed[i])
    mine = {}
    for x in signed:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "other text with words"), (9, "other text with words"), (None, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(df, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (0, 0), (7, 7), (9, 7)]
    assert simhash.near_duplicates(df.where("false"), ["doc_id"]).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (200, 203), (203, 201), (202, 201)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and all(got[i] == 200 for i in (201, 202, 203)) and all(got[i] == 1000 for i in range(1001, 1100))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_around_a_hot_node(spark):
    """The node in the middle has most links of the table, so the joins broadcast it; rings hang on some of its neighbours."""
    links = [(5000, i) for i in range(10_000, 13_000)] + [(i, i + 10_000) for i in range(10_000, 13_000, 3)] + [(30_000 + i, 30_000 + (i + 1) % 9) for i in range(9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 30_000 if n > 30_000 else 5000 for link in links for n in link if n not in (5000, 30_000)}


def exact(vectors, k, every):
    out = {}
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for q, x in good:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, y in good:
                if i != q and len(y) == len(x):
                    s = float((x * y).sum())
                    best[i] = max(s, best.get(i, -np.inf))
    return {q: sorted(((-s, i) for i, s in b.items()))[:k] for q, b in out.items()}


@pytest.mark.parametrize("block", [one_bit_search.BLOCK_ROWS, 60])
def test_search(spark, monkeypatch, block):
    if block == 60:
        for name, rows in (("BLOCK_ROWS", 60), ("QUERY_ROWS", 7), ("FETCH_ROWS", 90), ("TOGETHER", 3)):
            monkeypatch.setattr(one_bit_search, name, rows)
    r = np.random.default_rng(3)
    centre = r.standard_normal((20, 32))
    vectors = [(i, (centre[i % 20] * (i % 3) + r.standard_normal(32)).astype(np.float32).tolist()) for i in range(900)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)] + [(5, vectors[5][1]), (20, vectors[7][1]), (40, [1.0] * 8), (41, [2.0] * 8), (60, [0.0] * 32), (61, None), (62, []), (63, [None] * 32), (64, [float("nan")] * 32), (65, [float("inf")] * 32), (None, [1.0] * 32)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    want = exact(vectors, 20, 20)
    got = {}
    for x in one_bit_search.nearest(df, "vec_id", "embedding", sigmas=3.0).collect():
        got.setdefault(x.query_id, []).append(x)
    assert set(got) == {q for q, b in want.items() if b}
    hit = 0
    for q, rows in got.items():
        rows.sort(key=lambda x: x["rank"])
        assert [x["rank"] for x in rows] == list(range(1, len(want[q]) + 1))
        assert [(-x.score, x.vec_id) for x in rows] == sorted((-x.score, x.vec_id) for x in rows)
        near = {i: -s for s, i in want[q]}
        hit += sum(x.vec_id in near and abs(near[x.vec_id] - x.score) < 1e-9 for x in rows)
    assert hit / sum(map(len, want.values())) > 0.99
    assert one_bit_search.nearest(df.where("false"), "vec_id", "embedding").count() == 0


def test_estimates_from_bytes():
    """Sums of bytes give the product with the signs, and errors keep to their deviation."""
    r = np.random.default_rng(2)
    x, q = r.standard_normal((2000, 20)) * 3 + 1, r.standard_normal((130, 20))
    centre = x.mean(axis=0)
    bits, scalars = one_bit_search.encode(x, centre, 5)
    signs = np.unpackbits(bits, axis=1, count=20) * 2.0 - 1
    for i, estimate, spread in one_bit_search.estimates(bits, scalars, q, centre, 5):
        own = q[i : i + len(estimate)]
        plain = ((own - centre) @ one_bit_search.rotation(20, 5)) @ signs.T * (scalars[:, 0] / scalars[:, 1] / np.sqrt(20)) + scalars[:, 2] + (own @ centre - centre @ centre)[:, None]
        assert np.allclose(estimate, plain, atol=1e-3)
        off = (estimate - own @ x.T) / spread
        assert abs(off.mean()) < 0.1 and 0.85 < off.std() < 1.15


@pytest.mark.parametrize("folder, share", [("/root/testdata/sf0.01", 0.45), ("/root/testdata/sf0.1", 0.3)])
def test_search_recall_and_share(spark, folder, share):
    """Neighbours come through the codes: most rows are never computed exactly."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    found_rows, reaching = one_bit_search.search(rows, "vec_id", "embedding")
    computed = reaching.selectExpr("sum(length(queries) / 4)").first()[0]
    rows = rows.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in found_rows.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        found += len(set(ids[np.lexsort((ids, -score))[:20]]) & {v for _, v in got[ids[q]]})
    print(folder, found / (20 * len(got)), computed / (len(got) * len(ids)))
    assert found / (20 * len(got)) >= 0.97
    assert computed / (len(got) * len(ids)) <= share
