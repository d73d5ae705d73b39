"""Running states over a sorted table: each task runs over its part, and the parts are joined by what their ends hold."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serupa.session import stage


def running(df: DataFrame, order: list, segment: list[str], fields: str, start: tuple, step: Callable, after: Callable, name: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all, if not given; ``segment`` among them), with the running state ``fields`` of each row
    in its segment when the table is sorted by ``order``.

    Rows of a segment are next to each other in that order. ``step(state, row) -> state`` adds a row (a tuple of all
    columns) to the state before it, ``start`` at first; ``after(before, state)`` is the state that ``state``, made from
    ``start``, becomes when ``before`` comes first. A segment may span any number of parts: no task holds more than its part.
    One row per part, with the state at its end, goes through the driver. The result is staged, in no particular order.
    """
    columns, new = keep or df.columns, StructType.fromDDL(fields)
    at, kept = [df.columns.index(c) for c in segment], [df.columns.index(c) for c in columns]
    width, held_fields = len(columns), [df.schema[c] for c in columns]
    schema = StructType([*held_fields, *new.fields, *StructType.fromDDL("__part long, __row long, __first boolean").fields])

    def within(batches):
        part, count, nth, held, state = TaskContext.get().partitionId(), 0, -1, None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(row[i] for i in at)
                if own != held or nth < 0:
                    held, state, nth = own, start, nth + 1
                state = step(state, row)
                out.append((*state, part, count, nth == 0))
                count += 1
            yield pa.RecordBatch.from_arrays([*(batch.columns[i] for i in kept), *(pa.array(c) for c in zip(*out, strict=True))], schema.names)

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stage(parts.mapInArrow(within, schema), name)
    end = F.struct("__row", *segment, *new.names, "__first")
    ends = local.groupBy("__part").agg(F.max_by(end, "__row").alias("last"), F.min_by(F.struct(*segment), "__row").alias("first"))
    carries: dict[int, tuple] = {}
    before, held = start, None
    for part, last, first in sorted(map(tuple, ends.collect())):
        if tuple(first) == held:
            carries[part] = before
        own = tuple(last[n] for n in new.names)
        before = after(carries[part], own) if last["__first"] and part in carries else own
        held = tuple(last[n] for n in segment)
    if not carries:
        return local.drop("__part", "__row", "__first")

    def join_parts(batches):
        for batch in batches:
            state = [c.to_pylist() for c in batch.columns[width : width + len(new)]]
            part, first = batch.column(width + len(new)).to_pylist(), batch.column(width + len(new) + 2).to_pylist()
            for i, (p, f) in enumerate(zip(part, first, strict=True)):
                if f and p in carries:
                    for held, value in zip(state, after(carries[p], tuple(s[i] for s in state)), strict=True):
                        held[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(s, t) for s, t in zip(state, (c.type for c in batch.columns[width:]), strict=False))], [*columns, *new.names])

    return local.mapInArrow(join_parts, StructType([*held_fields, *new.fields]))
