"""Corpus-wide operators: titles, document frequency, dynamic stopwords, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings
from serupa.functions import text as tx
from serupa.session import stage


def titles(index: DataFrame) -> DataFrame:
    """Non-empty stored texts; only an index without any falls back to the title column."""
    stored = index.where(F.col("document") != "").select(F.col("document").alias("title"))
    if stored.isEmpty():
        stored = index.where(F.col("judul").isNotNull()).select(F.col("judul").alias("title"))
    return stored


def document_frequency(corpus: DataFrame, title: str = "title") -> DataFrame:
    """``word, n``: in how many titles a word occurs."""
    words = corpus.select(F.explode(tx.corpus_words(F.col(title))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def dynamic_stopwords(corpus: DataFrame, title: str = "title", settings: Settings = DEFAULTS) -> DataFrame:
    """``word, n, df`` of the words in at least ``stopword_df`` of all titles.

    Every title holds a limited number of words, hence few words can reach the limit, whatever the corpus size.
    """
    total = corpus.select(F.count("*").cast("double")).scalar()
    share = document_frequency(corpus, title).withColumn("df", F.col("n") / total)
    return share.where(F.col("df") >= settings.stopword_df)


def inline_words(stopwords: DataFrame, limit: int | None = None) -> list[str] | None:
    """The words as a list for a plan literal; None when there are more than ``limit``.

    Words in a share s of all titles number at most (words of the longest title) / s, whatever the corpus size.
    """
    words = stopwords.select("word")
    rows = (words.limit(limit + 1) if limit is not None else words).collect()
    return None if limit is not None and len(rows) > limit else sorted(row.word for row in rows)


def clean_titles(
    df: DataFrame,
    title: str,
    stopwords: DataFrame | None = None,
    key: str | None = None,
    out: str = "clean",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add the cleaned title; dynamic stopwords go into the expression, or are joined when they are many.

    The join form uses ``key``, a unique column of ``df``; without one, the rows are written down with a number.
    """
    words = [] if stopwords is None else inline_words(stopwords, settings.literal_words)
    if words is not None:
        return df.withColumn(out, tx.clean_title(F.col(title), words))
    if key is None:
        numbered = stage(df.withColumn("_row", F.monotonically_increasing_id()), "titles")
        return clean_titles(numbered, title, stopwords, "_row", out, settings).drop("_row")
    static = df.select(key, F.posexplode(tx.title_words(F.col(title))).alias("_at", "word"))
    kept = static.join(stopwords.select("word"), "word", "left_anti").groupBy(key)
    joined = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda s: s["word"]).alias("_w"))
    empty = F.array().cast("array<string>")
    return (
        df.join(joined, key, "left")
        .withColumn(out, tx.words_or_title(F.coalesce("_w", empty), F.col(title)))
        .drop("_w")
    )


def program_distribution(index: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    name = F.coalesce("program_studi", F.lit(settings.unknown_program)).alias("program_studi")
    return index.groupBy(name).agg(F.count("*").alias("n"))


def year_distribution(index: DataFrame) -> DataFrame:
    year: Column = F.col("tahun").cast("string").alias("tahun")
    return index.where(F.col("tahun") > 0).groupBy(year).agg(F.count("*").alias("n"))
