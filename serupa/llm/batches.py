"""Per-batch work on a text column: Arrow in, Arrow out, rows kept in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

SLICE_BYTES = 4 << 20  # text handled at once; a single longer text is handled alone


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES`` of text each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def map_text(df: DataFrame, fields: str, work: Callable, keep: list[str], text: str = "text", also: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` and the new ``fields``.

    ``work()`` is called once per task and gives ``fn(texts, *also) -> list of columns`` for slices of the
    rows; texts are bytes (UTF-8) or None. A kept column that has the name of a new one gives way to it.
    """
    new = StructType.fromDDL(fields)
    taken = {n.lower() for n in new.names}
    kept = [c for c in keep if c.lower() not in taken]
    also = also or []
    schema = StructType([df.schema[c] for c in kept] + new.fields)
    names, n_kept = schema.names, len(kept)
    at = kept.index(text) if text in kept and df.schema[text].dataType == StringType() else n_kept  # of the text; it moves once
    n_sent = max(n_kept, at + 1)

    def run(batches):
        fn = work()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for start, stop in slices(texts):
                size = stop - start
                rest = [batch.column(n_sent + i).slice(start, size) for i in range(len(also))]
                made = fn(texts.slice(start, size).to_pylist(), *rest)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(start, size) for i in range(n_kept)] + [pa.array(c) if not isinstance(c, pa.Array) else c for c in made], names)

    columns = [F.col(c) for c in kept] + [F.col(text).cast("string").alias("__text")] * (at == n_kept) + [F.col(c).alias(f"__also{i}") for i, c in enumerate(also)]
    return df.select(*columns).mapInArrow(run, schema)
