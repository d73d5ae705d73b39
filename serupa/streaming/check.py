"""Score unseen titles on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from serupa.config import DEFAULTS, Settings
from serupa.operators.encode import Encoder
from serupa.operators.ingest import check_queries, split_valid
from serupa.plans.check import similarity_check
from serupa.session import stage


def start_checks(
    titles: DataFrame,
    index: DataFrame | Callable[[], DataFrame],
    encoder: Encoder,
    output: str,
    checkpoint: str,
    dynamic=(),
    settings: Settings = DEFAULTS,
    **trigger,
) -> StreamingQuery:
    """Check every micro-batch of queries against the index and write its hits as ``output/batch=<n>``.

    ``index`` may be a callable, such as ``IndexTable.read``: each batch then sees the index of its time.
    Rejected titles go to ``output_rejected/batch=<n>`` with their errors. A replayed batch overwrites its
    own folders. Top-k needs whole query batches, hence foreachBatch.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split_valid(check_queries(batch, settings))
        rejected.write.mode("overwrite").parquet(f"{output}_rejected/batch={batch_id}")
        now = index() if callable(index) else index
        hits = similarity_check(stage(valid, "queries"), now, encoder, dynamic, settings)
        hits.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        titles.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
