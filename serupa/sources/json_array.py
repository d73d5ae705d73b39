"""JSON arrays of objects in splittable form: a file of any size is read by many tasks.

A file is read as text cut at every ``}``, which Spark splits by byte ranges like lines. A cut never parts an
escape, as ``\\}`` is none, so what a piece does depends only on whether it starts inside a string. For both cases
the task that reads a range tells each piece's braces outside strings and their running sums. Sums of whole ranges
along the file then give each piece its real state and depth; an object ends where the depth is 0 again. An object
without nested ones is a single piece and is never moved; only pieces of nested ones are shuffled to come together.

The sums along a file are one window of a row per range. Nothing else grows with the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from serupa.functions.text import strip
from serupa.session import stage

NOT_AN_ARRAY = "the export must be a JSON array"
_RANGE = ("file", "start")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between closing braces, in the order of its range of a file: ``file, start, row, text, quotes``, and what was
    before it in the range: ``parity`` of quotes and, if the range starts outside (0) or inside (1) a string, the depth
    that the piece adds and the one behind it."""
    text = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), plain.alias("plain"))
    rows = rows.withColumn("quotes", F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit(""))))
    strings, closed = r'"[^"]*("|$)', F.col("quotes") % 2  # the brace behind a piece counts if the piece ends outside a string
    rest = F.regexp_replace("plain", '^[^"]*("|$)', "")
    outside = _opened(F.regexp_replace("plain", strings, "")) - (1 - closed)
    inside = _opened(F.regexp_replace(rest, strings, "")) - closed
    rows = rows.select("file", "start", "text", "quotes", outside.alias("outside"), inside.alias("inside"))
    sums = "file string, start long, text string, quotes long, row long, parity long, adds0 long, adds1 long, after0 long, after1 long"
    return stage(rows.mapInArrow(_running_sums, sums), "pieces")


def _opened(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit("{"), F.lit("")))


def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task reads its ranges one after the other, each in order."""
    current, row, before, depth = None, 0, 0, np.zeros(2, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts, files = batch.column(1).to_numpy(), batch.column(0).dictionary_encode()
        codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
        cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1), n]
        quotes, outside, inside = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
        made = np.empty((6, n), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            key = (names[codes[a]], starts[a])
            if key != current:
                current, row, before, depth = key, 0, 0, np.zeros(2, np.int64)
            total = before + np.cumsum(quotes[a:b])
            parity = (total - quotes[a:b]) % 2
            adds = np.stack([np.where(parity == s, outside[a:b], inside[a:b]) for s in (0, 1)])
            after = depth[:, None] + np.cumsum(adds, axis=1)
            made[:, a:b] = np.concatenate([[row + np.arange(b - a), parity], adds, after])
            row, before, depth = row + b - a, total[-1], after[:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(quotes), *map(pa.array, made)], ["file", "start", "text", "quotes", "row", "parity", "adds0", "adds1", "after0", "after1"])


def _along(ranges: DataFrame, name: str, what: Column) -> DataFrame:
    """Add a sum over the ranges of a file before each."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn(name, F.coalesce(F.sum(what).over(earlier), F.lit(0)))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, row, record``: the objects of each file as JSON text, in the order of ``start`` and ``row``.

    Files are UTF-8. Everything but a (possibly empty) array of objects fails with ``NOT_AN_ARRAY``: at once if a file
    does not begin like an array or there is no text at all, else when the objects are read.
    """
    pieces = _pieces(spark, path)
    first = F.min_by(F.substring(strip(F.col("text")), 1, 1), "row").alias("first")
    marks = pieces.where("start = 0").groupBy("file").agg(first).groupBy("first").count().collect()  # a row per character
    if [m["first"] for m in marks] != ["["]:
        raise ValueError(NOT_AN_ARRAY)
    last = [F.max_by(c, "row").alias(c) for c in ("after0", "after1")]
    ranges = pieces.groupBy(*_RANGE).agg(F.sum("quotes").alias("quotes"), F.max("row").alias("last_row"), *last)
    ranges = _along(ranges, "quoted", F.col("quotes")).withColumn("quoted", F.col("quoted") % 2)
    ranges = _along(ranges, "depth", F.when(F.col("quoted") == 0, F.col("after0")).otherwise(F.col("after1")))
    final = F.col("start") == F.max("start").over(Window.partitionBy("file"))
    ranges = stage(ranges.select(*_RANGE, "quoted", "depth", F.when(final, F.col("last_row")).otherwise(-1).alias("tail_row")), "ranges")

    by_state = lambda name: F.when(F.col("quoted") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    after = F.col("depth") + by_state("after")
    rows = pieces.join(ranges, list(_RANGE)).select(
        *_RANGE, "row", "text", after.alias("after"), (after - by_state("adds")).alias("at"), (F.col("row") == F.col("tail_row")).alias("tail"),
        (F.col("parity") == F.col("quoted")).alias("outside"),
    )
    opening = (F.col("start") == 0) & (F.col("row") == 0)
    begins = (opening & F.regexp_like("text", F.lit(r"^\s*\[\s*\{"))) | (~opening & F.regexp_like("text", F.lit(r"^\s*,\s*\{")))
    closes = (opening & F.regexp_like("text", F.lit(r"^\s*\[\s*\]\s*$"))) | (~opening & (F.col("at") == 0) & F.regexp_like("text", F.lit(r"^\s*\]\s*$")))
    top = (F.col("at") <= 0) & F.col("outside")
    sound = F.when(F.col("tail"), closes).otherwise(~top | begins)
    text = F.when(top, F.regexp_replace("text", r"^[\s\[,]+", "")).otherwise(F.col("text"))
    body = F.concat(F.when(sound, text).otherwise(F.raise_error(F.lit(NOT_AN_ARRAY)).cast("string")), F.lit("}"))
    rows = rows.select(*_RANGE, "row", "at", "after", body.alias("body"), "tail").where("NOT tail OR body = ''")  # a tail is looked at, never kept
    single = rows.where("at = 0 AND after = 0").select("file", *_RANGE[1:], "row", F.col("body").alias("record"))

    parts = rows.where("at <> 0 OR after <> 0").withColumn("ends", (F.col("after") == 0).cast("long"))
    counts = _along(parts.groupBy(*_RANGE).agg(F.sum("ends").alias("n")), "earlier", F.col("n")).drop("n")
    running = Window.partitionBy(*_RANGE).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("ended", F.coalesce(F.sum("ends").over(running), F.lit(0))).join(counts, list(_RANGE))
    pieces_of = F.array_sort(F.collect_list(F.struct("start", "row", "body"))).alias("parts")
    nested = numbered.groupBy("file", (F.col("ended") + F.col("earlier")).alias("number")).agg(pieces_of)
    record = F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("record")
    return single.unionByName(nested.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["row"].alias("row"), record))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON array files as rows; fields that an object lacks, or of another type, are null."""
    return json_objects(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """Write rows as JSON array files, one a partition; null fields are left out."""

    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            if batch.num_rows:
                marks = pa.array([mark] + [","] * (batch.num_rows - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0), "")], ["value"])
                mark = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(bracket, "value string").write.text(path)
