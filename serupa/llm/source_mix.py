"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

1. Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words of the table. No target
   exceeds ``REPEATS`` times its source's words; the excess is shared again by weight.
2. Blocks of equal size are allocated to the sources by highest quotients target / (2k + 1). Only quotients that
   a bound leaves open are listed, a few per source. Each source's blocks are allocated to its shards likewise,
   by the shards' words. Shards are hash buckets of about ``SHARD_DOCS`` documents, so no group is large.
3. In each shard the documents are laid end to end in an order drawn by the seed and cut into blocks. The quota
   takes all blocks as often as it covers them whole, and the rest from a block drawn by the seed on, around the end.

Block size: a hundredth of the smallest target, so that rounding stays small for every source, 1 to 1024 words.
Everything is drawn from MD5 of seed, id and text, so reruns agree.

Defined results: null texts and texts of white space have size 0 and take 0. The null source is one source.
Repeated rows are separate documents. With no words at all every target is 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serupa.session import stage

REPEATS = 3
SHARD_DOCS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def draw(*parts: Column) -> Column:
    """A number below 2**32 drawn from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add rank, weight and target to (source, source_size), one row per source."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * REPEATS)
    # Fill from the lowest cap per weight on: the level a source sees if all below it are capped. It rises while
    # sources are capped and falls afterwards, so the highest is the one that holds.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onwards = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / onwards
    filled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).drop("level", "cap")


def apportion(parties: DataFrame, votes: str, seats: str, names: list[str], within: list[str]) -> DataFrame:
    """Add quota: the ``seats`` of each group ``within``, allocated to its parties by highest quotients votes / (2k + 1).

    Ties go to the smaller name. A divisor that hands out at most (at least) all seats gives each party's
    least (most) seats; only the quotients between are ranked.
    """
    group = Window.partitionBy(*within)
    total, count = F.sum(votes).over(group), F.sum((F.col(votes) > 0).cast("long")).over(group)
    share = lambda n: F.floor(F.coalesce(F.try_divide(F.col(votes) * n, F.col("_total")), F.lit(0.0)) + 0.5)
    bounded = parties.withColumn("_total", total.cast("double")).withColumn("_count", count)
    bounded = bounded.withColumn("_least", F.greatest(F.lit(0), share(F.greatest(F.lit(0.0), F.col(seats) - F.col("_count") / 2)) - 1))
    bounded = bounded.withColumn("_most", share(F.col(seats) + F.col("_count") / 2) + 1)
    bounded = bounded.withColumn("_open", F.col(seats) - F.sum("_least").over(group))
    listed = bounded.withColumn("_seat", F.explode(F.sequence(F.col("_least"), F.col("_most"))))
    best = Window.partitionBy(*within).orderBy(F.desc(F.col(votes) / (2 * F.col("_seat") + 1)), *names)
    won = listed.withColumn("_won", (F.row_number().over(best) <= F.col("_open")) & (F.col(votes) > 0))
    kept = [c for c in parties.columns if c not in (*names, *within)]
    return won.groupBy(*within, *names).agg(
        *[F.first(c).alias(c) for c in kept], (F.first("_least") + F.sum(F.col("_won").cast("long"))).alias("quota")
    )


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``keep`` columns with size, source_size, target (their source's) and taken (words the mix takes of the document)."""
    made = {"size", "source_size", "target", "taken"}
    keep = [c for c in keep if c.lower() not in made]
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    rows = stage(docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(source).cast("string").alias("source"), words.alias("size"), drawn.alias("drawn")), "sizes")

    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    alone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(alone)
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.coalesce(F.floor(least / 100), F.lit(1))))
    sized = sources.withColumn("block", block).withColumn("blocks", F.floor((F.sum("source_size").over(alone) + F.floor(F.col("block") / 2)) / F.col("block")))
    shards = F.greatest(F.lit(1), F.floor(F.col("docs") / shard_docs))
    quotas = stage(apportion(sized, "target", "blocks", ["rank"], []).withColumn("shards", shards), "sources")

    number = F.pmod(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long"), F.col("shards"))
    placed = rows.alias("r").join(quotas.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")))
    placed = placed.select("r.*", "rank", "source_size", "target", number.alias("shard"))
    sums = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    parts = sums.join(quotas.select("rank", "block", F.col("quota").alias("source_quota")), "rank")
    dealt = stage(apportion(parts, "shard_size", "source_quota", ["shard"], ["rank"]), "shards")

    in_shard = Window.partitionBy("rank", "shard").orderBy("drawn", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("start", F.coalesce(F.sum("size").over(in_shard), F.lit(0))).join(dealt, ["rank", "shard"])
    whole = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * REPEATS)
    laid = laid.withColumn("rounds", F.coalesce(F.floor(F.try_divide(whole, F.col("shard_size"))), F.lit(0)))
    laid = laid.withColumn("rest", whole - F.col("rounds") * F.col("shard_size"))
    first = F.pmod(draw(F.lit(str(seed)), F.col("rank").cast("string"), F.col("shard").cast("string")), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))))
    laid = laid.withColumn("from", first * F.col("block")).withColumn("end", F.col("start") + F.col("size"))
    until = F.col("from") + F.col("rest")
    here = F.greatest(F.lit(0), F.least("end", until) - F.greatest("start", "from"))
    around = F.greatest(F.lit(0), F.least(F.col("end"), until - F.col("shard_size")) - F.col("start"))
    return laid.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + here + around).cast("long").alias("taken"),
    )


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mix(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS drawn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, {REPEATS} * source_size AS cap FROM s),
v AS (SELECT a.rank, any_value((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.rank < a.rank)), 0))::DOUBLE
    / any_value((SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight > a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.rank >= a.rank)))::DOUBLE AS level FROM w a GROUP BY a.rank, a.cap, a.weight),
t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT max(level) FROM v)) AS target FROM w),
k AS (SELECT greatest(1, least(1024, coalesce(floor((SELECT min(target) FROM t WHERE target > 0) / 100), 1)))::BIGINT AS block),
m AS (SELECT ((SELECT sum(source_size) FROM s)::BIGINT + block // 2) // block AS blocks FROM k),
a AS (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS n FROM (SELECT rank, target, unnest(range(0, (SELECT blocks FROM m) + 1)) AS k FROM t WHERE target > 0)) WHERE n <= (SELECT blocks FROM m)),
q AS (SELECT t.*, (SELECT count(*) FROM a WHERE a.rank = t.rank) AS quota, greatest(1, docs // {SHARD_DOCS}) AS shards FROM t),
p AS (SELECT d.*, q.rank, q.source_size, q.target, q.quota AS source_quota, ('0x' || d.drawn[1:8])::BIGINT % q.shards AS shard FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT rank, shard, any_value(source_quota) AS source_quota, sum(size)::BIGINT AS shard_size FROM p GROUP BY rank, shard),
c AS (SELECT rank, shard FROM (SELECT rank, shard, source_quota, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k + 1) DESC, shard) AS n
    FROM (SELECT *, unnest(range(0, source_quota + 1)) AS k FROM h WHERE shard_size > 0)) WHERE n <= source_quota),
e AS (SELECT h.*, block, (SELECT count(*) FROM c WHERE c.rank = h.rank AND c.shard = h.shard) AS quota FROM h, k),
f AS (SELECT *, least(quota * block, {REPEATS} * shard_size) AS whole,
    ('0x' || md5('42:' || rank || ':' || shard)[1:8])::BIGINT % greatest(1, ceil(shard_size / block)::BIGINT) * block AS start_at FROM e),
g AS (SELECT *, CASE WHEN shard_size > 0 THEN whole // shard_size ELSE 0 END AS rounds FROM f),
l AS (SELECT p.*, shard_size, rounds, start_at, whole - rounds * shard_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY drawn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s0 FROM p JOIN g ON p.rank = g.rank AND p.shard = g.shard)
SELECT doc_id, size::BIGINT AS size, source_size, target, (rounds * size + greatest(0, least(s0 + size, start_at + rest) - greatest(s0, start_at))
    + greatest(0, least(s0 + size, start_at + rest - shard_size) - s0))::BIGINT AS taken FROM l
"""
