"""Lexical and hybrid scores, levels and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings
from serupa.functions.binding import bind
from serupa.functions.rounding import percent_text, round4
from serupa.functions.text import SPACE


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct words; 0 when both are empty."""

    def share(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["a"], s["b"]))
        return bind(shared.cast("double"), lambda n: n / F.nullif(F.size(s["a"]) + F.size(s["b"]) - n, F.lit(0.0)))

    return F.coalesce(bind(F.struct(a.alias("a"), b.alias("b")), share), F.lit(0.0))


def jaccard(text_a: Column, text_b: Column) -> Column:
    """Jaccard similarity of two white-space token sets."""
    return set_jaccard(word_set(text_a), word_set(text_b))


def hybrid(semantic: Column, lexical: Column, settings: Settings = DEFAULTS) -> Column:
    return round4(semantic * settings.hybrid_semantic + lexical * settings.hybrid_lexical)


def level(score: Column, settings: Settings = DEFAULTS) -> Column:
    (bound, name), *rest = settings.level_bounds
    out = F.when(score >= bound, name)
    for bound, name in rest:
        out = out.when(score >= bound, name)
    return out.otherwise(settings.level_lowest)


def persen(score: Column) -> Column:
    return percent_text(score)


def warning(score: Column, score_text: Column, settings: Settings = DEFAULTS) -> Column:
    """Warning for the best hit of a query; null below the highest level."""
    bound, name = settings.level_bounds[0]
    return F.when(
        score >= bound,
        F.concat(
            F.lit(f"Ditemukan judul dengan kemiripan {name} ("),
            score_text,
            F.lit("). Pertimbangkan untuk merevisi judul atau topik penelitian Anda."),
        ),
    )
