"""Similarity check of a table of titles against the index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serupa import schemas
from serupa.config import DEFAULTS, Settings
from serupa.functions import scoring
from serupa.functions import text as tx
from serupa.functions.binding import bind
from serupa.functions.rounding import round4
from serupa.operators.cells import topk_cosine_cells
from serupa.operators.encode import Encoder, encode_texts
from serupa.operators.skew import join_unique
from serupa.operators.topk import NO_FLOOR, topk_cosine
from serupa.session import stage, stage_alone

_WORD_BYTES = 8  # of a text of words, about


class EmptyIndex(LookupError):
    """A check needs an index with at least one document."""


def parse_hit_id(document_id: Column, stored_type: Column, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Number and type of a hit, read from its id.

    ``skripsi_12`` is (12, skripsi). A last part that is no number gives (0, unknown). Without ``_`` the
    type is the stored one and the number is the id if it is all digits, else 0.
    """
    parts = F.split(document_id, "_")
    number = F.trim(F.element_at(parts, -1)).try_cast("bigint")
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    plain = F.coalesce(F.when(document_id.rlike("^[0-9]+$"), document_id.try_cast("bigint")), F.lit(0))
    split = document_id.contains("_")
    return (
        F.when(split, F.coalesce(number, F.lit(0))).otherwise(plain).cast("bigint"),
        F.when(split, F.when(number.isNull(), "unknown").otherwise(head)).otherwise(
            F.coalesce(stored_type, F.lit(settings.default_type))
        ),
    )


def semantic_floor(threshold: Column, settings: Settings = DEFAULTS) -> Column:
    """Lowest cosine a hit can have when its hybrid score reaches ``threshold``.

    The lexical part gives at most its weight, and the two roundings to 4 decimals at most 5e-5 each.
    Leaving out pairs below cannot change a rank either: whatever outranks a hit is above the floor too.
    """
    if settings.hybrid_semantic <= 0:
        return F.lit(NO_FLOOR)
    return (threshold - 1e-4 - settings.hybrid_lexical) / settings.hybrid_semantic - 1e-4


def _scored(hits: DataFrame, lexical: Column, settings: Settings) -> DataFrame:
    """Add ``similarity_score``. As a generated row it is computed once; a plain column would also move into a join condition."""
    score = scoring.hybrid(round4(F.col("cosine")), lexical, settings)
    return hits.select("*", F.inline(F.array(F.struct(score.alias("similarity_score")))))


def _score_few(found: DataFrame, asked: DataFrame, titles: DataFrame, dynamic, settings: Settings) -> DataFrame:
    """All hits of a document go in one small row to its text, which is cleaned once, inside the scan."""
    words = scoring.word_set(tx.clean_title(F.col("document"), dynamic))
    lists = found.groupBy("id").agg(F.collect_list(F.struct("query_id", "cosine", "semantic_rank")).alias("_hits"))
    cleaned_hits = titles.join(F.broadcast(lists), "id").withColumn("_hit_words", words).drop("document")
    hits = cleaned_hits.select(*[c for c in cleaned_hits.columns if c != "_hits"], F.inline("_hits"))
    return _scored(hits.join(asked, "query_id"), scoring.set_jaccard(F.col("_words"), F.col("_hit_words")), settings)


def text_of_words(words: Column) -> list[Column]:
    """A word set as one sorted text, its number of words and its digest, which stands for it."""
    text = F.array_join(F.array_sort(words), " ")  # no word holds a blank
    return [text.alias("_text"), F.size(words).alias("_n"), F.unhex(F.sha2(text, 256)).alias("_digest")]


def _score_many(
    search: Callable[[], DataFrame], asked: DataFrame, titles: DataFrame, dynamic, same_texts: bool, bounded: bool, settings: Settings
) -> DataFrame:
    """Each word set is kept once; pairs carry its digest and size. ``bounded``: the ids of the hits can be broadcast.

    The sizes bound the lexical score, and pairs that cannot reach their threshold are left out. Each two different texts
    meet once, however many pairs they stand for: the smaller one goes to the larger.
    """
    # One document may be the hit of very many queries, its copies for instance. The vectors kept for the search go with its end.
    found = stage_alone(asked.sparkSession, search, "found")
    uses = found.groupBy("id").agg(F.count("*").alias("_uses"))
    titles = titles.join(F.broadcast(uses) if bounded else uses, "id")
    sized = lambda df, words: df.select("*", *text_of_words(words)).drop("_words", "document")
    asked = stage(sized(asked, F.col("_words")), "asked")
    texts = asked.select("_digest", "_text")
    if same_texts:
        stored = titles.drop("document").join(asked.select(F.col("query_id").alias("id"), "_n", "_digest"), "id")
    else:
        words = scoring.word_set(tx.clean_title(F.col("document"), dynamic))
        stored = stage(sized(titles.withColumn("_words", words), F.col("_words")), "titles")
        texts = texts.unionByName(stored.select("_digest", "_text"))
        stored = stored.drop("_text")
    hits = join_unique(found, stored.withColumnsRenamed({"_n": "_hit_n", "_digest": "_hit_digest"}), "id", "_uses")
    pairs = hits.join(asked.drop("_text"), "query_id")
    most = F.coalesce(F.least("_n", "_hit_n") / F.nullif(F.greatest("_n", "_hit_n").cast("double"), F.lit(0.0)), F.lit(0.0))
    if settings.hybrid_lexical >= 0:
        pairs = _scored(pairs, most, settings).where(F.col("similarity_score") >= F.col("threshold")).drop("similarity_score")
    pairs = by_size(pairs).select(*found.columns, "document_id", "document_type", "threshold", "_small", "_n_small", "_large", "_n_large")
    pairs = stage(pairs, "pairs")
    return _scored(with_lexical(pairs, texts, F.lit(True), settings), F.col("_lexical"), settings)


def by_size(pairs: DataFrame) -> DataFrame:
    """Name the two texts of a pair ``_small`` and ``_large`` instead of by ``_digest``, ``_n``, ``_hit_digest`` and ``_hit_n``."""
    own, other = F.struct("_n", "_digest"), F.struct(F.col("_hit_n").alias("_n"), F.col("_hit_digest").alias("_digest"))
    named = pairs.select("*", F.least(own, other).alias("_a"), F.greatest(own, other).alias("_b"))
    return named.select(
        *[c for c in pairs.columns if c not in ("_n", "_digest", "_hit_n", "_hit_digest")],
        F.col("_a._digest").alias("_small"), F.col("_a._n").alias("_n_small"),
        F.col("_b._digest").alias("_large"), F.col("_b._n").alias("_n_large"),
    )


def with_lexical(pairs: DataFrame, texts: DataFrame, needed: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``_lexical`` to pairs of ``by_size``: 0 where it is not ``needed``.

    Pairs of equal texts, which may be very many, take part in no join, nor do those that need no score.
    """
    joins = needed & (F.col("_small") != F.col("_large"))
    alike = F.when(needed & (F.col("_n_small") > 0), 1.0).otherwise(0.0)
    met, rest = pairs.where(joins), pairs.where(~joins).withColumn("_lexical", alike)
    return join_unique(met, jaccard_of_texts(met, texts, settings), ["_small", "_large"], "_pairs").unionByName(rest)


def _shared_words(a: str, b: str) -> Column:
    """Number of words that two word sets, as blank-separated texts, have in common."""

    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([len(set(x.split(" ")).intersection(y.split(" "))) for x, y in pairs], pa.int32())

    return F.arrow_udf(count, "int")(a, b)


def jaccard_of_texts(pairs: DataFrame, texts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``_lexical`` of each two texts that ``pairs`` names by digests, and the number of its ``_pairs``.

    A text goes along with each link in which it is the smaller. Where that is much more than all texts, the links are
    met in rounds, by their larger text, and the copies of a round are gone before the next.
    """
    links = stage(pairs.groupBy("_small", "_large", "_n_small", "_n_large").agg(F.count("*").alias("_pairs")), "links")
    words = links.agg(F.sum(F.col("_n_small").cast("long"))).first()[0] or 0
    rounds = 1
    if words * _WORD_BYTES > settings.copied_bytes:
        held = texts.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
        rounds = -(-words * _WORD_BYTES // max(settings.copied_bytes, held, 1))
    texts = texts.dropDuplicates(["_digest"])

    def shares(links: DataFrame, larger: DataFrame) -> DataFrame:
        met = links
        for side, texts_of_side in (("_small", texts), ("_large", larger)):
            uses = links.groupBy(side).agg(F.count("*").alias("_uses"))
            held = texts_of_side.select(F.col("_digest").alias(side), F.col("_text").alias(f"_text{side}"))
            met = join_unique(met, held.join(uses, side), side, "_uses")
        shared = F.when(F.col("_n_small") > 0, _shared_words("_text_small", "_text_large")).otherwise(0).cast("double")
        share = bind(shared, lambda n: n / (F.col("_n_small") + F.col("_n_large") - n))
        return met.select("_small", "_large", share.alias("_lexical"), "_pairs")

    def part(n: int) -> DataFrame:
        own = lambda digest: F.pmod(F.xxhash64(F.lit("round"), digest), F.lit(rounds)) == n
        return shares(links.where(own("_large")), texts.where(own("_digest")))

    if rounds == 1:
        return stage(shares(links, texts), "shares")  # read more than once by its join
    return reduce(DataFrame.unionByName, [stage(part(n), "shares") for n in range(rounds)])


def similarity_hits(
    queries: DataFrame,
    index: DataFrame,
    encoder: Encoder,
    dynamic=(),
    settings: Settings = DEFAULTS,
    approximate: bool = False,
    cells: bool = False,
    same_texts: bool = False,
) -> DataFrame:
    """Hits of valid queries, with ``semantic_rank`` for ordering: top-k by cosine, then the hybrid threshold.

    ``queries``: query_id, judul, top_k, threshold, document_type, optionally exclude_id and a ready
    ``embedding``. ``dynamic``: dynamic stopwords. The index is scanned twice, for vectors and for the
    titles of the hits, each time only the columns needed. ``cells`` searches by trained cells, with the same result;
    ``approximate`` probes some of them only. ``same_texts``: the queries are the index, title by title, with its ids.
    """
    if index.isEmpty():
        raise EmptyIndex("Belum ada data skripsi yang diindeks. Jalankan sinkronisasi terlebih dahulu.")
    cleaned = queries.withColumn("_clean", tx.clean_title(F.col("judul"), dynamic))
    if "embedding" not in queries.columns:
        cleaned = encode_texts(cleaned, "_clean", encoder)
    count, distinct, most = queries.agg(F.count("*"), F.countDistinct("query_id"), F.max("top_k")).first()
    if distinct < count:
        raise ValueError("query_id must be unique and not null")
    floored = cleaned.withColumn("floor", semantic_floor(F.col("threshold"), settings))

    def search() -> DataFrame:
        if approximate or cells:
            return topk_cosine_cells(floored, index, encoder.dim, exact=not approximate, settings=settings)
        return topk_cosine(floored, index, encoder.dim, settings=settings)

    titles = index.select("id", "document", "document_id", "document_type")
    asked = cleaned.select("query_id", "threshold", scoring.word_set(F.col("_clean")).alias("_words"))
    pairs = count * (most or 1)
    if pairs <= min(settings.shipped_pairs, settings.broadcast_rows):
        scored = _score_few(search(), asked, titles, dynamic, settings)
    else:
        scored = _score_many(search, asked, titles, dynamic, same_texts, pairs <= settings.broadcast_rows, settings)
    number, kind = parse_hit_id(F.coalesce("document_id", "id"), F.col("document_type"), settings)
    kept = scored.where(F.col("similarity_score") >= F.col("threshold"))
    return kept.select(
        "query_id",
        F.coalesce("document_id", "id").alias("id"),
        number.alias("document_id"),
        kind.alias("document_type"),
        F.when(kind == "skripsi", number).alias("skripsi_id"),
        "similarity_score",
        scoring.persen(F.col("similarity_score")).alias("similarity_persen"),
        scoring.level(F.col("similarity_score"), settings).alias("level"),
        F.col("semantic_rank").cast("int").alias("semantic_rank"),
    )


def in_report_order(hits: DataFrame) -> DataFrame:
    """Best hybrid score first; equal scores keep their semantic order."""
    return hits.orderBy("query_id", F.desc("similarity_score"), "semantic_rank")


def similarity_check(queries: DataFrame, index: DataFrame, encoder: Encoder, dynamic=(),
                     settings: Settings = DEFAULTS, approximate: bool = False) -> DataFrame:
    hits = similarity_hits(queries, index, encoder, dynamic, settings, approximate)
    return in_report_order(hits).select(*schemas.HIT_COLUMNS)


def similarity_summary(queries: DataFrame, hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per query: ``total_found``, its hits in report order and the warning; also without hits."""
    fields = [F.col(c) for c in schemas.HIT_COLUMNS if c != "query_id"]
    hit = F.struct((-F.col("similarity_score")).alias("_s"), F.col("semantic_rank"), F.struct(*fields).alias("hit"))
    ordered = F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["hit"])  # at most top_k per query
    lists = hits.groupBy("query_id").agg(ordered.alias("results"))
    joined = queries.select("query_id", "judul").join(lists, "query_id", "left")
    best = F.get(F.col("results"), F.lit(0))
    return joined.select(
        "query_id",
        F.struct("judul").alias("query"),
        F.when(F.col("results").isNull(), 0).otherwise(F.size("results")).cast("bigint").alias("total_found"),
        "results",
        scoring.warning(best["similarity_score"], best["similarity_persen"], settings).alias("peringatan"),
    )
