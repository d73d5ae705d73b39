"""Direct comparison of title pairs, without the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings
from serupa.functions import scoring
from serupa.functions import text as tx
from serupa.functions.rounding import round4, snap
from serupa.functions.vectors import cosine
from serupa.operators.encode import Encoder, encode_texts


def compare_pairs(pairs: DataFrame, encoder: Encoder, dynamic=(), settings: Settings = DEFAULTS) -> DataFrame:
    """Add score, text, level and the two detail scores of ``judul_a`` and ``judul_b``.

    Here the hybrid score mixes the unrounded cosine; only the details are rounded.
    """
    cleaned = pairs.withColumns({f"_{s}": tx.clean_title(F.col(f"judul_{s}"), dynamic) for s in "ab"})
    for s in "ab":
        cleaned = encode_texts(cleaned, f"_{s}", encoder, f"_v{s}")
    scored = cleaned.withColumns(
        {"_semantic": snap(cosine(F.col("_va"), F.col("_vb"))), "_lexical": scoring.jaccard(F.col("_a"), F.col("_b"))}
    )
    score = scoring.hybrid(F.col("_semantic"), F.col("_lexical"), settings)
    return scored.withColumn("similarity_score", score).select(
        *pairs.columns,
        "similarity_score",
        scoring.persen(F.col("similarity_score")).alias("similarity_persen"),
        scoring.level(F.col("similarity_score"), settings).alias("level"),
        round4(F.col("_semantic")).alias("semantic_score"),
        round4(F.col("_lexical")).alias("lexical_score"),
    )


def score_pairs(pairs: DataFrame, encoder: Encoder, dynamic=(), settings: Settings = DEFAULTS) -> DataFrame:
    """Labelled pairs with their scores, as the evaluation wants them."""
    compared = compare_pairs(pairs, encoder, dynamic, settings)
    return compared.withColumnRenamed("similarity_score", "score").drop("similarity_persen")
