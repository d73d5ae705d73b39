import numpy as np
import pytest
from pyspark.sql import functions as F

from serupa.config import Settings
from serupa.functions import scoring
from serupa.operators import encode, topk
from serupa.operators.encode import HashEncoder, PandasEncoder, encode_documents, encode_texts
from serupa.operators.index import index_rows
from serupa.operators.ingest import with_columns
from serupa.operators.skew import join_unique
from serupa.operators.topk import topk_cosine
from serupa.plans import check
from serupa.plans.check import EmptyIndex, similarity_check, similarity_hits, similarity_summary
from serupa.plans.compare import compare_pairs
from serupa.plans.near_duplicates import near_duplicates
from serupa.schemas import DOC, INDEX

DIM = 8


def vectors(spark, n=300, seed=1, copies=100):
    """Random small-integer vectors, a third of them equal, with types."""
    rng = np.random.default_rng(seed)
    raw = rng.integers(-3, 4, (n, DIM)).astype(float)
    raw[:copies] = raw[0]
    raw[n - 3] = 0
    rows = [(f"d{i:04d}", [float(x) for x in raw[i]], "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id STRING, embedding ARRAY<FLOAT>, document_type STRING").repartition(5), raw


def brute(raw, queries, floor=-2.0):
    norms = np.linalg.norm(raw, axis=1)
    out = set()
    for qid, vec, k, kind, exclude in queries:
        n = np.linalg.norm(vec)
        found = []
        for i in range(len(raw)):
            name = f"d{i:04d}"
            if name == exclude or (kind and "ab"[i % 2] != kind):
                continue
            cos = float(raw[i] @ vec / (norms[i] * n)) if norms[i] * n else 0.0
            cos = np.floor(cos * 1e10 + 0.5) / 1e10
            if cos >= floor:
                found.append((-cos, name))
        out |= {(qid, name, rank, round(float(-c), 9)) for rank, (c, name) in enumerate(sorted(found)[:k], 1)}
    return out


def asked(spark, raw, n=60):
    rows = [
        (i, [float(x) for x in raw[i]], 1 + i % 20, [None, "a", "b", ""][i % 4], f"d{i:04d}" if i % 3 else None)
        for i in range(0, len(raw), len(raw) // n)
    ]
    schema = "query_id BIGINT, embedding ARRAY<FLOAT>, top_k INT, document_type STRING, exclude_id STRING"
    return spark.createDataFrame(rows, schema), rows


def result(found):
    return {(r.query_id, r.id, r.semantic_rank, round(r.cosine, 9)) for r in found.collect()}


@pytest.mark.parametrize("settings", [Settings(), Settings(broadcast_bytes=0, tile_rows=37)], ids=["broadcast", "tiled"])
@pytest.mark.parametrize("floor", [-2.0, 0.3])
def test_topk_equals_brute_force(spark, settings, floor):
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw)
    got = result(topk_cosine(queries.withColumn("floor", F.lit(floor)), corpus, DIM, settings=settings))
    want = brute(raw, [(q, np.array(v), k, t, x) for q, v, k, t, x in rows], floor)
    assert got == want


def test_rows_without_vector_are_skipped(spark):
    corpus = spark.createDataFrame([("a", None), ("b", [1.0, 0.0])], "id STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query_id STRING, embedding ARRAY<FLOAT>")
    for settings in (Settings(), Settings(broadcast_bytes=0)):
        got = topk_cosine(queries, corpus, 2, k=3, settings=settings).collect()
        assert [(r.query_id, r.id, r.cosine, r.semantic_rank) for r in got] == [("q", "b", 1.0, 1)]


def test_widths_are_checked(spark):
    corpus = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 0.0, 1.0, 0.0]), ("c", [1.0, 0.0, 0.0])], "id STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id STRING, embedding ARRAY<FLOAT>")
    for settings in (Settings(), Settings(broadcast_bytes=0)):
        with pytest.raises(Exception, match="width 3 expected"):
            topk_cosine(queries, corpus, 3, k=1, settings=settings).collect()


def test_no_cap_on_k_and_a_floor_per_query(spark):
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw, 12)
    wide = queries.withColumns({"top_k": F.lit(70) + F.col("query_id") % 7, "floor": F.when(F.col("query_id") % 2 == 0, 0.2)})
    want = set()
    for q, v, _, t, x in rows:
        want |= brute(raw, [(q, np.array(v), 70 + q % 7, t, x)], 0.2 if q % 2 == 0 else -2.0)
    for settings in (Settings(), Settings(broadcast_bytes=0, tile_rows=37)):
        assert result(topk_cosine(wide, corpus, DIM, settings=settings)) == want


def test_repeated_query_ids_are_refused(spark):
    with pytest.raises(ValueError, match="unique"):
        similarity_check(ask(spark, (1, "Deteksi", 5, 0.5, None), (1, "Padi", 5, 0.5, None)), small_index(spark), HashEncoder())


def test_model_runs_in_one_job_of_its_own(spark):
    rows = [(f"skripsi_{i}", "skripsi", ["judul sama", f"judul {i}"][i % 2], "abstrak sama" if i % 3 else None, f"kata {i % 4}") for i in range(400)]
    docs = documents(spark, rows)
    many = encode_documents(docs, count_encoder())
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and "ArrowEvalPython" not in plan
    got = {r.document_id: r.embedding for r in many.collect()}
    assert len(got) == 400 and got["skripsi_4"] == got["skripsi_16"] and got["skripsi_1"] is not None


def test_empty_sides(spark):
    corpus, _ = vectors(spark)
    none = corpus.where("false")
    queries = corpus.select(F.col("id").alias("query_id"), "embedding")
    assert topk_cosine(queries, none, DIM, k=2).count() == 0
    assert topk_cosine(queries.where("false"), corpus, DIM, k=2).count() == 0


@pytest.mark.parametrize("share", [1e-9, 0.2])
def test_join_unique_with_hot_key(spark, share, monkeypatch):
    monkeypatch.setattr("serupa.operators.skew.HOT_SHARE", share)
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("uses"), F.max("id").alias("top"))
    got = join_unique(left, right, "k", "uses").orderBy("id").collect()
    assert [(r.id, r.top) for r in got] == [(i, 4998 if i % 3 == 0 else i) for i in range(5000)]


def unit(text, dim=256):
    import hashlib

    v = np.zeros(dim)
    for token in text.lower().split():
        code = int(hashlib.md5(token.encode()).hexdigest()[:9], 16)
        v[(code >> 4) % dim] += 1 - 2 * (code & 1)
    return v / np.linalg.norm(v) if v.any() else v


def test_hash_encoder(spark):
    rows = [("deteksi padi padi",), ("",), (None,), ("Ünal naïve 12",)]
    got = encode_texts(spark.createDataFrame(rows, "t STRING"), "t", HashEncoder()).collect()
    by_text = {r.t: r.embedding for r in got}
    assert by_text[None] is None
    for text in ("deteksi padi padi", "", "Ünal naïve 12"):
        assert by_text[text] == pytest.approx(unit(text), abs=1e-7)


def count_encoder():
    def load():  # nested, so that it travels to the workers by value
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])

    return PandasEncoder(load, 3, "count")


def test_pandas_encoder_reuses_texts(spark):
    rows = [(i, ["aa", "abc", None][i % 3]) for i in range(90)]
    out = encode_texts(spark.createDataFrame(rows, "n INT, t STRING"), "t", count_encoder())
    got = out.orderBy("n").collect()
    assert len(got) == 90 and got[2].embedding is None
    assert got[0].embedding == pytest.approx([2 / 3, 2 / 3, 1 / 3]) and got[88].embedding == got[1].embedding


def documents(spark, rows):
    df = spark.createDataFrame(rows, "document_id STRING, document_type STRING, judul STRING, abstrak STRING, kata_kunci STRING")
    return with_columns(df, DOC)


def test_document_vector_is_weighted_sum(spark):
    docs = documents(spark, [("skripsi_1", "skripsi", "Deteksi Padi", " " + "x " * 300, " knn, web "), ("skripsi_2", "skripsi", "Deteksi Padi", "  ", None)])
    got = {r.document_id: r.embedding for r in encode_documents(docs, HashEncoder()).collect()}
    want = 0.7 * unit("deteksi padi") + 0.2 * unit("x " * 150) + 0.1 * unit("knn web")
    assert got["skripsi_1"] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert got["skripsi_2"] == pytest.approx(unit("deteksi padi"), abs=1e-6)


def small_index(spark):
    rows = [
        ("skripsi_42", "skripsi", "Deteksi Penyakit Padi dengan CNN", None, None),
        ("internship_report_7", "skripsi", "Deteksi Penyakit Jagung", None, None),
        ("skripsi_9", "skripsi", "Blockchain Rekam Medis", None, None),
    ]
    return index_rows(documents(spark, rows), HashEncoder())


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id BIGINT, judul STRING, top_k INT, threshold DOUBLE, document_type STRING")


def test_check(spark):
    index = small_index(spark)
    queries = ask(
        spark,
        (1, "Deteksi Penyakit Padi dengan CNN", 5, 0.0, None),
        (2, "Musik Gamelan", 5, 0.9, None),
        (3, "Deteksi Penyakit Padi dengan CNN", 5, 0.5, "internship_report"),
    )
    rows = similarity_check(queries, index, HashEncoder()).collect()
    first = [r for r in rows if r.query_id == 1]
    assert [r.id for r in first] == ["skripsi_42", "internship_report_7", "skripsi_9"]
    assert (first[0].document_id, first[0].document_type, first[0].skripsi_id) == (42, "skripsi", 42)
    assert (first[1].document_id, first[1].document_type, first[1].skripsi_id) == (7, "internship_report", None)
    assert first[0].similarity_persen == "100.0%" and first[0].level == "SANGAT TINGGI"
    assert [r.similarity_score for r in first] == sorted((r.similarity_score for r in first), reverse=True)
    assert {r.query_id for r in rows} == {1}  # 2 stays below its threshold, 3 asks for a type nobody has stored


def test_summary(spark):
    queries = ask(spark, (1, "Deteksi Penyakit Padi dengan CNN", 5, 0.5, None), (2, "Musik Gamelan", 5, 0.9, None))
    hits = similarity_hits(queries, small_index(spark), HashEncoder())
    got = {r.query_id: r for r in similarity_summary(queries, hits).collect()}
    assert got[1].total_found >= 1 and got[1].results[0].id == "skripsi_42"
    assert got[1].peringatan == (
        "Ditemukan judul dengan kemiripan SANGAT TINGGI (100.0%). "
        "Pertimbangkan untuk merevisi judul atau topik penelitian Anda."
    )
    assert got[2].total_found == 0 and got[2].peringatan is None and got[2].query.judul == "Musik Gamelan"


def test_empty_index_is_an_error(spark):
    with pytest.raises(EmptyIndex):
        similarity_check(ask(spark, (1, "Deteksi", 5, 0.5, None)), spark.createDataFrame([], INDEX), HashEncoder())


def test_large_forms_give_the_same_report(spark):
    words = "padi jagung sawah daun citra suara teks data jaringan sensor air tanah".split()
    rng = np.random.default_rng(3)
    titles = [" ".join(rng.choice(words, 4)) for _ in range(120)]
    titles[:40] = ["padi sawah daun citra"] * 40
    rows = [(f"skripsi_{i}", "skripsi", t, None, None) for i, t in enumerate(titles)]
    index = index_rows(documents(spark, rows), HashEncoder()).cache()

    def report(**options):
        got = near_duplicates(index, HashEncoder(), settings=Settings(**options)).collect()
        return sorted((r.source_id, r.id, r.similarity_score, r.semantic_rank) for r in got)

    plain = report()
    assert report(broadcast_bytes=0, broadcast_rows=0, tile_rows=25) == plain
    assert sum(1 for r in plain if r[0] == "skripsi_0" and r[2] == 1.0) == 5
    assert all(r[0] != r[1] for r in plain)


def test_texts_do_not_travel_with_every_pair(spark, monkeypatch):
    """Of the pairs found, two different texts meet once, and only if their sizes let them reach the threshold."""
    rng = np.random.default_rng(5)
    words = [f"kata{i}" for i in range(400)]
    titles = ["padi sawah daun citra"] * 60 + [" ".join(rng.choice(words, n)) for n in (4, 40, 300) for _ in range(30)] + ["", "- -"]
    index = index_rows(documents(spark, [(f"skripsi_{i}", "skripsi", t, None, None) for i, t in enumerate(titles)]), HashEncoder()).cache()
    wide, real = [], check.join_unique

    def counted(left, right, *how):
        out = real(left, right, *how)
        if any(c == "_hit_words" or c.startswith("_text") for c in out.columns):
            wide.append(out.count())
        return out

    monkeypatch.setattr(check, "join_unique", counted)

    def report(threshold, **options):
        got = near_duplicates(index, HashEncoder(), threshold=threshold, settings=Settings(**options)).collect()
        return sorted((r.source_id, r.id, r.similarity_score, r.semantic_rank) for r in got)

    plain = report(0.2)
    assert not wide and len(plain) > 300
    assert report(0.2, broadcast_rows=0) == plain
    assert wide and max(wide) <= 90 * 5
    wide.clear()
    assert report(0.6, broadcast_rows=0) == report(0.6)
    assert wide and max(wide) < len(titles)  # of five pairs a title; copies and pairs of unlike sizes need no text


def test_equal_texts_and_unlike_sizes_meet_nobody(spark, monkeypatch):
    """Only pairs that need a lexical score take part in its joins; each gets that of its word sets."""
    texts = ["a b c d", "d c b a", "b c d e", "", "  ", "a " + " ".join(f"w{i}" for i in range(30)), "x y z v"]
    rows = [(i, j, texts[i], texts[j]) for i in range(7) for j in range(7) for _ in range(3)]
    df = spark.createDataFrame(rows, "i INT, j INT, a STRING, b STRING").withColumn("want", scoring.jaccard(F.col("a"), F.col("b")))
    sized = df.select("*", *check.text_of_words(scoring.word_set(F.col("a")))).drop("_text")
    held = sized.select("*", *[c.alias(f"_hit{n}") for c, n in zip(check.text_of_words(scoring.word_set(F.col("b"))), ("_text", "_n", "_digest"), strict=True)])
    pairs = check.by_size(held.drop("_hit_text")).cache()
    known = df.select(*check.text_of_words(scoring.word_set(F.col("a")))).select("_digest", "_text")
    links, real = [], check.stage
    monkeypatch.setattr(check, "stage", lambda df, name: links.append(df.count()) or real(df, name) if name == "links" else real(df, name))
    got = check.with_lexical(pairs, known, F.lit(True)).collect()
    assert len(got) == len(rows) and all(r._lexical == r.want for r in got)
    assert links.pop() == 10  # five different word sets
    close = F.col("_n_small") >= F.col("_n_large") * 0.5
    got = check.with_lexical(pairs, known, close).collect()
    assert len(got) == len(rows) and all((r._lexical >= 0.5) == (r.want >= 0.5) for r in got)
    assert links == [3]


def test_corpus_is_dealt_out_before_it_is_copied(spark, monkeypatch):
    """Few tasks may hold all vectors, when they pack well; each makes its copies only after a shuffle by id."""
    met = []
    monkeypatch.setattr(topk, "_meet", lambda q, c, *how: met.append(c.rdd.getNumPartitions()) or c)
    corpus, _ = vectors(spark, 300)
    queries = corpus.coalesce(1).withColumn("query_id", F.col("id")).withColumn("top_k", F.lit(5))
    topk._tiled(queries, corpus.coalesce(1), DIM, 300, 300, Settings(tile_rows=30))
    assert met[0] > 1


def test_copies_are_told_by_digests(spark, monkeypatch):
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw)
    staged, real = {}, topk.stage
    monkeypatch.setattr(topk, "stage", lambda df, name: staged.setdefault(name, df.columns) and real(df, name))
    got = result(topk_cosine(queries, corpus, DIM, settings=Settings(broadcast_bytes=0, tile_rows=37)))
    assert got == brute(raw, [(q, np.array(v), k, t, x) for q, v, k, t, x in rows])
    assert "embedding" not in staged["answers"]  # no join on whole vectors


def test_compare_pairs(spark):
    pairs = spark.createDataFrame([(1, "Deteksi Padi", "deteksi padi"), (2, "Deteksi", "Musik")], "no BIGINT, judul_a STRING, judul_b STRING")
    for encoder in (HashEncoder(), count_encoder()):
        got = {r.no: r for r in compare_pairs(pairs, encoder).collect()}
        assert got[1].similarity_score == 1.0 and got[1].level == "SANGAT TINGGI"
        assert got[2].lexical_score == 0.0


def side(raw, k=None):
    """Numpy vectors as a side of the search; ``k`` makes it a query side that excludes nothing."""
    n = len(raw)
    none, norm = np.full(n, None, object), np.linalg.norm(raw.astype(np.float64), axis=1)
    if k is None:
        return topk._Side(np.array([f"d{i:05d}" for i in range(n)], object), raw, norm, none)
    return topk._Side(np.arange(n), raw, norm, none, np.full(n, k), none, np.full(n, topk.NO_FLOOR))


def best_of(raw, corpus, k):
    """By all cosines in double precision."""
    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros(x.shape), where=n > 0)
    cosine = np.floor(unit(raw.astype(np.float64)) @ unit(corpus.astype(np.float64)).T * 1e10 + 0.5) / 1e10
    return np.argsort(-cosine, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("k", [5, 51])
def test_few_pairs_are_computed_in_double_precision(monkeypatch, k):
    raw = np.random.default_rng(4).standard_normal((20_000, 64)).astype(np.float32)
    corpus, queries = side(raw), side(raw[:256], k)
    corpus = topk._in_id_order(corpus)
    made, unit = [], topk._Side.unit
    monkeypatch.setattr(topk._Side, "unit", lambda self, rows=slice(None): made.append(len(got := unit(self, rows))) or got)
    monkeypatch.setattr(topk, "_in_id_order", lambda c: c)
    best = topk._Best(queries)
    assert len(corpus.single) == len(raw) and len(queries.single) == 256
    made.clear()  # what follows is made for exact cosines
    best.add(corpus)
    got = best.rows["id"].str[1:].astype(int).to_numpy().reshape(256, k)
    assert (got == best_of(raw[:256], raw, k)).all()
    assert sum(made) < 0.1 * 256 * len(raw)


def test_closer_than_single_precision_can_tell():
    """Vectors that differ in the last bits, copies and zero vectors; more of them than a block may leave open."""
    rng = np.random.default_rng(6)
    raw = np.repeat(rng.standard_normal((3, 16)), 2000, axis=0) + 1e-6 * rng.integers(-3, 4, (6000, 16))
    raw[1000:1400], raw[5000:5300] = raw[1000], 0
    raw = raw[rng.permutation(len(raw))]
    best = topk._Best(side(raw[:300], 7))
    for part in (slice(0, 4500), slice(4500, None)):
        whole = side(raw)
        best.add(topk._Side(whole.ids[part], whole.raw[part], whole.norm[part], whole.types[part]))
    got = best.rows["id"].str[1:].astype(int).to_numpy().reshape(300, 7)
    assert (got == best_of(raw[:300], raw, 7)).all()


def test_tiles_are_few_and_bounded():
    """Every tile of one side is a copy of the other: at 64 and 256 dimensions they are as large as a task may hold."""
    for dim, rows in ((64, 262_144), (256, 65_536), (4096, 4096)):
        assert Settings().rows_a_tile(dim) == rows
    assert Settings(tile_rows=37).rows_a_tile(64) == 37


def test_encoding_holds_little_in_double_precision():
    """Beside a batch and its vectors only a slice of it is in memory, and slices give the same vectors."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    lists = [None if i % 97 == 0 else [int(x) for x in rng.integers(0, 1 << 36, i % 40)] for i in range(10_000)]
    codes = pa.array(lists, pa.list_(pa.int64()))
    sums = encode._bucket_sums(256).func
    tracemalloc.start()
    got = sums(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 10_000 * 256 * 4 + (8 << 20)
    for i in (0, 1, 511, 512, 513, 9999):
        assert got[i].as_py() == sums(codes.slice(i, 1))[0].as_py()
