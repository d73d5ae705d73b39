"""Field weights of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serupa.config import DEFAULTS, Settings
from serupa.functions.vectors import EPSILON


def resolve_weights(title: Column, abstract: Column, keywords: Column, settings: Settings = DEFAULTS) -> Column:
    """Struct ``judul, abstrak, kata_kunci`` of non-negative weights that sum to 1.

    Null takes the default and a negative weight counts as 0. If nothing is left the defaults apply,
    and a title-only weight if even those are zero.
    """
    defaults = (settings.weight_title, settings.weight_abstract, settings.weight_keywords)
    given = [
        F.greatest(F.coalesce(weight.cast("double"), F.lit(float(default))), F.lit(0.0))
        for weight, default in zip((title, abstract, keywords), defaults, strict=True)
    ]
    total = given[0] + given[1] + given[2]
    floor = [max(float(d), 0.0) for d in defaults]
    spare = [d / sum(floor) for d in floor] if sum(floor) > EPSILON else [1.0, 0.0, 0.0]
    names = ("judul", "abstrak", "kata_kunci")
    return F.struct(
        *[
            F.when(total > EPSILON, weight / F.nullif(total, F.lit(0.0))).otherwise(F.lit(fallback)).alias(name)
            for weight, fallback, name in zip(given, spare, names, strict=True)
        ]
    )
