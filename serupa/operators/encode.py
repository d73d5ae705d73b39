"""Text encoders and document encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa.config import DEFAULTS, Settings
from serupa.functions import text as tx
from serupa.functions.vectors import weighted_embedding
from serupa.functions.weights import resolve_weights
from serupa.operators.skew import join_unique
from serupa.session import stage

_ROWS = 512  # of a batch whose sums are held in double precision at once
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


class Encoder:
    """Text to unit vector. ``reuse`` asks for one call per distinct text instead of one per row."""

    name: str
    dim: int
    reuse = False

    def column(self, text: Column) -> Column:
        raise NotImplementedError


class HashEncoder(Encoder):
    """Signed feature hashing of word tokens; deterministic and cheap.

    Tokens and their hash codes are built-in expressions. Only the sum per bucket, which SQL could
    express solely by exploding and regrouping every document, runs vectorised on Arrow batches.
    """

    def __init__(self, dim: int = 256) -> None:
        self.name = f"hash-{dim}"
        self.dim = dim
        self._sum_codes = _bucket_sums(dim)

    def column(self, text: Column) -> Column:
        tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        # 36 bits of the MD5: the upper 32 pick the bucket, the lowest the sign.
        codes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("bigint"))
        return self._sum_codes(codes)


def _bucket_sums(dim: int):
    def sums(codes: pa.Array) -> pa.Array:
        rows = len(codes)
        out = np.empty((rows, dim), np.float32)
        for i in range(0, rows, _ROWS):
            out[i : i + _ROWS] = units(codes.slice(i, _ROWS))
        return pa.ListArray.from_arrays(
            pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(dim)),
            pa.array(out.ravel()),
            mask=codes.is_null() if codes.null_count else None,
        )

    def units(codes: pa.Array) -> np.ndarray:
        rows = len(codes)
        lengths = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False)
        flat = codes.flatten().to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(rows, dtype=np.int64), lengths) * dim + (flat >> 4) % dim
        counts = np.bincount(cells, weights=1.0 - 2.0 * (flat & 1), minlength=rows * dim)
        counts = counts.astype(np.float64).reshape(rows, dim)
        norms = np.sqrt(np.square(counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)

    return F.arrow_udf(sums, VECTOR)


class PandasEncoder(Encoder):
    """Wraps a user model: ``load()`` runs once per Python worker and returns ``texts -> (n, dim) array``."""

    reuse = True

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, name: str, batch: int = 32):
        self.name, self.dim = name, dim

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                out = np.empty((len(texts), dim), np.float32)
                for i in range(0, len(texts), batch):
                    part = np.asarray(model(list(texts[i : i + batch])), dtype=np.float64)
                    norms = np.linalg.norm(part, axis=1, keepdims=True)
                    out[i : i + batch] = np.divide(part, norms, out=np.zeros_like(part), where=norms > 0)
                yield pd.Series(list(out), index=texts.index)

        self._udf = F.pandas_udf(encode, VECTOR)

    def column(self, text: Column) -> Column:
        return self._udf(text)


def encode_texts(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """Add the vector of a text column; with ``encoder.reuse`` equal texts are encoded once."""
    if not encoder.reuse:
        return df.withColumn(out, encoder.column(F.col(text)))
    uses = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("_uses"))
    vectors = uses.withColumn(out, encoder.column(F.col(text)))
    return join_unique(df, vectors, text, "_uses", how="left")


def encode_documents(
    docs: DataFrame,
    encoder: Encoder,
    dynamic: Iterable[str] = (),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``embedding``: cleaned title, cut abstract and keywords, weighted, summed and normalised."""
    weights = resolve_weights(F.col("bobot_judul"), F.col("bobot_abstrak"), F.col("bobot_kata_kunci"), settings)
    parts = docs.withColumns(
        {
            "_judul": tx.clean_title(F.col("judul"), dynamic),
            "_abstrak": tx.abstract_text(F.col("abstrak"), settings),
            "_kata_kunci": tx.keyword_text(F.col("kata_kunci")),
            "_w": weights,
        }
    )
    names = ("judul", "abstrak", "kata_kunci")
    if encoder.reuse:
        vectors = _encode_parts_once(parts, encoder, names)
    else:
        vectors = parts.withColumns({f"_v_{n}": encoder.column(F.col(f"_{n}")) for n in names})
    embedding = weighted_embedding([F.col(f"_v_{n}") for n in names], [F.col("_w")[n] for n in names])
    return vectors.withColumn("embedding", embedding).select(*docs.columns, "embedding")


def _encode_parts_once(parts: DataFrame, encoder: Encoder, names: tuple[str, ...]) -> DataFrame:
    """One encoder call per distinct text over all fields, one join back, one regrouping.

    Documents are numbered in a staged copy, so a task that runs again gives the same numbers. The vectors are written to
    the scratch folder, so the encoder runs in a job of its own. Missing texts, often most of them, do not enter the join.
    A text that very many documents share makes a large partition of it, which the adaptive skew join splits.
    """
    numbered = stage(parts.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = numbered.drop("_row")
    texts = parts.select(F.explode(F.array(*[F.col(f"_{n}") for n in names])).alias("_text")).where("_text is not null")
    encoded = stage(texts.distinct().withColumn("_v", encoder.column(F.col("_text"))), "vectors")
    whole = F.struct(*[F.col(c) for c in parts.columns])
    cells = [F.struct(F.lit(i).alias("part"), F.col(f"_{n}").alias("_text"), (whole if i == 0 else F.lit(None).cast(parts.schema)).alias("doc")) for i, n in enumerate(names)]
    rows = numbered.select("_row", F.inline(F.array(*cells)))
    missing = rows.where("_text IS NULL").withColumn("_v", F.lit(None).cast(encoded.schema["_v"].dataType))
    joined = rows.where("_text IS NOT NULL").join(encoded, "_text").unionByName(missing).groupBy("_row")
    vector = lambda i: F.max_by("_v", F.when(F.col("part") == i, 1)).alias(f"_v_{names[i]}")
    back = joined.agg(F.max_by("doc", F.when(F.col("part") == 0, 1)).alias("doc"), *map(vector, range(len(names))))
    return back.select("doc.*", *[f"_v_{n}" for n in names])
