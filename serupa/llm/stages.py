"""Pipeline stages: (spark, docs, folder) -> what is kept of ``docs``, with its columns.

Inside a stage the columns have positional names, so extra columns of any name pass through unchanged.
Null and empty texts are no documents of a language, so the first stage drops them; the others accept them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.decontaminate import contamination
from serupa.llm.language_net import UNKNOWN, fit_network, predict
from serupa.llm.pii_field import fit_field, mask
from serupa.llm.simhash import near_duplicates
from serupa.llm.source_mix import mix
from serupa.session import ship_package, stage

BROADCAST_BYTES = 64 << 20  # numbers of dropped rows that are sent to all tasks


def _positional(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The table with columns c0, c1, ..., their names, and the new name of each old one."""
    ship_package(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, dict(zip(docs.columns, names, strict=True))


def keep_recognised_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that have no letter or are in no learned language, as told by a network with a background class.

    A table without labelled rows teaches no language; then every document with a letter stays.
    """
    rows, names, new = _positional(docs)
    net = fit_network(rows, new["doc_id"], new["text"], new["lang"], background=True)
    if net is None:
        return rows.where(F.coalesce(F.col(new["text"]).rlike(r"\p{L}"), F.lit(False))).toDF(*docs.columns)
    found = predict(rows, net, names, new["text"])
    return found.where(F.col("lang_pred") != UNKNOWN).select(*names).toDF(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id, null last; of several such rows, the first by text, then any one.

    Rows are told apart by numbers of a staged copy, so columns of any type pass, and the rows that stay are not moved:
    the numbers of those that go are few enough to be sent to them, or are joined.
    """
    rows, names, new = _positional(docs)
    key, text = new["doc_id"], new["text"]
    rows = stage(rows.select(*names, F.monotonically_increasing_id().alias("row")), "rows")
    classes = near_duplicates(rows.select(key, text, "row", F.xxhash64(text).alias("draw")), ["row", "draw"], key, text)
    classes = stage(classes.select("class_id", key, "row", "draw"), "near_classes")
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), "draw", "row")
    first = classes.groupBy("class_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = stage(classes.select("row").join(first, "row", "left_anti"), "gone")
    few = gone.count() * 16 <= BROADCAST_BYTES
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents of which one word in twenty stands in benchmark passages."""
    rows, names, new = _positional(docs)
    found = contamination(rows, spark.read.parquet(f"{folder}/benchmark.parquet"), names, new["text"])
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by its kind in angle brackets; n_chars follows the new text."""
    rows, names, new = _positional(docs)
    found = mask(rows, [n for n in names if n != new["text"]], new["text"], fit_field(rows, new["text"]))
    changed = {new["text"]: F.col("masked_text")}
    if "n_chars" in new:
        changed[new["n_chars"]] = F.length("masked_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(n, F.col(n)).alias(n) for n in names]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of what is left: doc_id, size, source_size, target and taken, then the document's text, lang and source.

    The mix is made of narrow rows; texts join it once, by row number.
    """
    rows, names, new = _positional(docs)
    rows = stage(rows.select(*names, F.monotonically_increasing_id().alias("row")), "rows")
    made = mix(rows, [new["doc_id"], "row"], new["doc_id"], new["source"], new["text"])
    content = [F.col(new[c]).alias(c) for c in ("text", "lang", "source") if c in new]
    return made.withColumnRenamed(new["doc_id"], "doc_id").join(rows.select("row", *content), "row").drop("row")
