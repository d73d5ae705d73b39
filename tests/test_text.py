import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serupa.functions import text as tx
from serupa.functions.text import STOPWORDS
from serupa.operators import corpus


def plain_clean(title, dynamic=()):
    """Row-at-a-time model of the cleaning rules."""
    if not title:
        return ""
    low = re.sub(r"\b([a-z0-9]+)[-/.](([a-z0-9]+)\b)?", r"\1\3", title.lower())
    words = re.sub(r"[^a-z0-9\s]", " ", low).split()
    kept = [w for w in words if len(w) >= 3 and w not in STOPWORDS and w not in dynamic]
    return " ".join(kept) if kept else title.strip()


GOLDEN = [
    ("Deteksi Penyakit Diabetes Menggunakan KNN", "deteksi penyakit diabetes knn"),
    ("Implementasi Sistem Berbasis Web", "web"),
    ("Judul: Dengan, Tanda! Baca?", "judul tanda baca"),
    ("ai di era digital", "era digital"),
    ("", ""),
    ("sistem dan aplikasi", "sistem dan aplikasi"),
    ("Deep Learning for Image Classification", "deep learning image classification"),
    ("Analisis K-Means", "kmeans"),
    ("Sistem E-Commerce", "ecommerce"),
    ("Evaluasi UI/UX", "uiux"),
    ("Klasifikasi C4.5", "klasifikasi c45"),
    ("AES-256 real-time", "aes256 realtime"),
    ("é.com ünal-ker", "com nal ker"),
    ("dan/atau/yang", "danatau"),
    ("a-b-c-d", "a-b-c-d"),
    ("abc-def-ghi", "abcdef ghi"),
    ("   Dan  ", "Dan"),
]


def test_clean_title_golden(values):
    got = values([(t,) for t, _ in GOLDEN], "t STRING", tx.clean_title(F.col("t")))
    assert got == [want for _, want in GOLDEN]
    assert values([(None,)], "t STRING", tx.clean_title(F.col("t"))) == [""]


def test_clean_title_dynamic(values):
    got = values([("Blockchain Keamanan Data",)], "t STRING", tx.clean_title(F.col("t"), ["blockchain"]))
    assert got == ["keamanan data"]


def test_clean_title_matches_model(values):
    alphabet = st.sampled_from(list("abkz019 -/.,_éñ \t\nDK") + ["dan ", "sistem", "K-Means", " "])
    cases = []

    @settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.lists(alphabet, max_size=20).map("".join))
    def gather(title):
        cases.append(title)

    gather()
    got = values([(t,) for t in cases], "t STRING", tx.clean_title(F.col("t")))
    assert got == [plain_clean(t) for t in cases]


def test_index_text(values):
    rows = [
        ("Judul Skripsi", None, None),
        (" J ", "A" * 1000, " k "),
        ("J", "", ""),
        ("J", "   ", "k"),
    ]
    got = values(rows, "j STRING, a STRING, k STRING", tx.index_text(F.col("j"), F.col("a"), F.col("k")))
    assert got == ["Judul Skripsi", "J | " + "A" * 300 + " | k", "J", "J |  | k"]
    assert values([(" x ",)], "j STRING", tx.query_text(F.col("j"))) == ["x"]


def test_field_texts(values):
    got = values([("  ",), (" ab ",), (None,)], "t STRING", tx.abstract_text(F.col("t")), tx.keyword_text(F.col("t")))
    assert got == [(None, None), ("ab", "ab"), (None, None)]


def test_tiny_corpus_makes_all_words_stopwords(spark):
    df = spark.createDataFrame([("Deteksi K-Means padi",), ("padi padi jagung",)], "title STRING")
    got = {(r.word, r.n) for r in corpus.dynamic_stopwords(df).collect()}
    assert got == {("deteksi", 1), ("means", 1), ("padi", 2), ("jagung", 1)}


def test_stopword_limit_is_inclusive(spark):
    rows = [("jarang",)] * 3 + [(f"judul{i:02d}",) for i in range(17)]
    df = spark.createDataFrame(rows, "title STRING")
    assert [r.word for r in corpus.dynamic_stopwords(df).collect()] == ["jarang"]


def test_many_stopwords_are_joined(spark):
    docs = spark.createDataFrame([(1, "deteksi padi sawah"), (2, "Padi"), (3, None), (4, "jagung manis")], "k INT, t STRING")
    words = spark.createDataFrame([("padi",), ("manis",)], "word STRING")
    few = corpus.clean_titles(docs, "t", words)
    many = corpus.clean_titles(docs, "t", words, key="k", settings=type(tx.DEFAULTS)(literal_words=1))
    want = {1: "deteksi sawah", 2: "Padi", 3: "", 4: "jagung"}
    assert {r.k: r.clean for r in few.collect()} == want
    assert {r.k: r.clean for r in many.collect()} == want
    unkeyed = corpus.clean_titles(docs, "t", words, settings=type(tx.DEFAULTS)(literal_words=1))
    assert unkeyed.columns == few.columns and {r.k: r.clean for r in unkeyed.collect()} == want


def test_any_number_of_stopwords(spark):
    docs = spark.createDataFrame([(1, " ".join(f"kata{i:05d}" for i in range(10_500)) + " padi")], "k INT, t STRING")
    words = corpus.dynamic_stopwords(docs.where("k = 1").select(F.regexp_replace("t", " padi$", "").alias("title")))
    assert len(corpus.inline_words(words)) == 10_500 and corpus.inline_words(words, 10_000) is None
    assert corpus.clean_titles(docs, "t", words, "k").first().clean == "padi"


def test_titles_fall_back_to_title_column(spark):
    none = spark.createDataFrame([(None, "a"), ("", "b"), (None, None)], "document STRING, judul STRING")
    assert sorted(r.title for r in corpus.titles(none).collect()) == ["a", "b"]
    some = spark.createDataFrame([("x", "a"), ("", "b")], "document STRING, judul STRING")
    assert [r.title for r in corpus.titles(some).collect()] == ["x"]
