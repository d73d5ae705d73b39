"""Prefix trie of conversations by the Euler-tour technique.

1. Turns are numbered in their conversations, and every conversation is rebuilt: the first turns of the first
   conversation of its five, then its own. A running polynomial fingerprint of (role, text) modulo 2**61 - 1, twice, names
   each prefix; equal prefixes are one node, grouped with its members, its smallest member and its parent's fingerprint.
2. Nodes are numbered in the order (parent, smallest member), so children of a node have consecutive numbers. Each
   node gets an arc in and an arc out; the arcs' successors are the tour.
3. The tour is list-ranked: tasks contract what is linked inside their part of the arcs, which lie by conversation,
   into one segment a chain; rounds of random mates halve long lists of segments until ``FINISH`` are left, which one
   task ranks; then ranks go back down to the arcs.
4. Running sums over the arcs in tour order give, at a node's two arcs, the leaves and the savings of its subtree.

Numbering, fingerprints and sums are running states over sorted parts (``scans.running``), so a conversation or a node that
holds most rows is spread over tasks. Lists of members are written as text in pieces before one task hashes a
node's pieces in order: SHA-256 has no parallel form, but that task holds one piece at a time.

Defined results: rows without conv_id take no part. Null roles and texts are empty. Turns are ordered by turn, null first,
then by role and text; rows that repeat all of these are turns of their own. The smallest multiple of five not above a negative id
is not used: ids are cut towards zero. Turnless conversations are members of the root. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.scans import running
from serupa.operators.skew import join_unique
from serupa.session import stage

EVERY, SPLITS = 5, 9  # conversations that share a beginning, and numbers of turns of it
PRIME = (1 << 61) - 1
BASES = (1_000_003_579_246_813, 2_000_000_011_357_924_681)
PART_ARCS = 1 << 18  # arcs that a task contracts
FINISH = 1 << 14  # segments that one task ranks
PIECE = 1 << 16  # characters of a list of members written at once
KEY = ["depth", "f1", "f2"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, bytes): turns by place, with two hashes of role and text and the UTF-8 length of the text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text"))
    half = lambda first: F.conv(F.substring("digest", first, 15), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).withColumns({"h1": half(1), "h2": half(16), "bytes": F.octet_length("text").cast("long")}).drop("digest")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(rows, order, ["conv_id"], "n long", (0,), lambda s, _: (s[0] + 1,), lambda a, b: (a[0] + b[0],), "turns", ["conv_id", "h1", "h2", "bytes"])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, bytes) of all rebuilt conversations, in the order n; turnless ones have no rows."""
    split = F.crc32(F.col("conv_id").cast("string")) % SPLITS
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("first"), split.alias("split"))
    heads = turns.where((F.col("conv_id") % EVERY == 0) & (F.col("n") < SPLITS)).withColumnRenamed("conv_id", "first")
    columns = ["conv_id", "n", "h1", "h2", "bytes"]
    shared = heads.join(convs, "first").where(F.col("n") <= F.col("split"))  # at most EVERY conversations on either side of zero use a first one
    return shared.select(*columns).unionByName(turns.where(F.col("n") > split).select(*columns))


def _extend(state, row):
    depth, f1, f2, _, _ = state
    return depth + 1, (f1 * BASES[0] + row[2] + 1) % PRIME, (f2 * BASES[1] + row[3] + 1) % PRIME, f1, f2


def _joined(before, state):
    """The fingerprint of a prefix whose beginning is ``before``."""
    (d, a1, a2, _, _), (n, b1, b2, p1, p2) = before, state
    shift = [pow(b, n - 1, PRIME) for b in BASES]
    return (
        d + n, (a1 * shift[0] * BASES[0] + b1) % PRIME, (a2 * shift[1] * BASES[1] + b2) % PRIME,
        (a1 * shift[0] + p1) % PRIME, (a2 * shift[1] + p2) % PRIME,
    )


def prefixes(rows: DataFrame) -> DataFrame:
    """Rebuilt turns with the fingerprints of the prefix that they end and of the one before."""
    return running(rows, ["conv_id", "n"], ["conv_id"], "depth long, f1 long, f2 long, p1 long, p2 long", (0, 0, 0, 0, 0), _extend, _joined, "prefixes", ["conv_id", "bytes"])


def _contract(batches):
    """Chains inside a part as one segment each: (id, head, offset) of all; a chain's last member has its end and total."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
    following = table["next"].fill_null(-1).to_numpy()
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, following, sorter=order), len(ids) - 1)
    inside = (ids[order[at]] == following) & (following >= 0)
    before = np.arange(len(ids))
    before[order[at[inside]]] = np.flatnonzero(inside)
    head, offset = before.copy(), np.where(before == np.arange(len(ids)), 0, weight[before])
    while True:
        further = head[head]
        if (further == head).all():
            break
        offset = offset + offset[head]
        head = further
    last = ~inside
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids), pa.array(ids[head]), pa.array(offset), pa.array(last),
            pa.array(following, mask=~last | (following < 0)), pa.array(offset + weight, mask=~last),
        ],
        ["id", "head", "offset", "last", "next", "weight"],
    )


_CONTRACTED = "id long, head long, offset long, last boolean, next long, weight long"


def list_rank(arcs: DataFrame, near: list[str], count: int, name: str = "tour") -> DataFrame:
    """(id, place): places from 0 of a list of ``count`` rows (id, next); next is null at its end.

    Columns ``near`` tell rows apart and lie near each other where links do.
    """
    parts = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ARCS))
    weighted = arcs.withColumn("weight", F.lit(1).cast("long"))
    levels = [stage(weighted.repartitionByRange(parts, *near).select("id", "next", "weight").mapInArrow(_contract, _CONTRACTED), name)]
    segments = levels[0].where("last").select(F.col("head").alias("id"), "next", "weight")
    turn = 0
    while segments.count() > FINISH:
        coin = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2))
        x = segments.where(coin == 0).select(F.col("id").alias("x"), F.col("next").alias("x_next"), F.col("weight").alias("x_weight"))
        y = segments.where(coin == 1).select(F.col("id").alias("y"), F.col("next").alias("y_next"), F.col("weight").alias("y_weight"))
        mates = stage(x.join(y, F.col("x_next") == F.col("y"), "full_outer"), f"{name}{turn}")
        absorbed = F.col("x").isNotNull() & F.col("y").isNotNull()
        levels.append(mates.where(absorbed).select(F.col("y").alias("id"), F.col("x").alias("head"), F.col("x_weight").alias("offset")))
        total = F.coalesce("x_weight", F.lit(0)) + F.coalesce("y_weight", F.lit(0))
        segments = mates.select(F.coalesce("x", "y").alias("id"), F.when(F.col("y").isNotNull(), F.col("y_next")).otherwise(F.col("x_next")).alias("next"), total.alias("weight"))
        turn += 1
    # FINISH rows at most, in one task
    places = stage(segments.repartition(1).mapInArrow(_contract, _CONTRACTED).select("id", F.col("offset").alias("place")), f"{name}_places")
    for n, level in enumerate(levels[:0:-1]):
        known = places.select(F.col("id").alias("head"), "place")
        places = stage(places.unionByName(level.join(known, "head").select("id", (F.col("place") + F.col("offset")).alias("place"))), f"{name}_places{n}")
    return levels[0].join(places.withColumnRenamed("id", "head"), "head").select("id", (F.col("place") + F.col("offset")).alias("place"))


def member_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the members' ids, ascending and comma-joined, for each node (``KEY``) at which conversations end."""

    def write(batches):
        held, first, ids, size, out = None, 0, [], 0, []

        def flush():
            if ids:
                out.append((*held, first, ",".join(map(str, ids))))

        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != held or size >= PIECE:
                    flush()
                    held, first, ids, size = node, conv, [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "first", "ids"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "first", "ids"])

    def digest(batches):
        held, sha, out = None, None, []
        for batch in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != held:
                    if held is not None:
                        out.append((*held, sha.hexdigest()))
                    held, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, sha.hexdigest())], [*KEY, "ends_sha256"])

    key = ", ".join(f"{k} long" for k in KEY)
    order = [*KEY, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, f"{key}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    own = numbered(turns)
    convs = own.select("conv_id").distinct()
    prefix = prefixes(rebuilt(own))
    inner = prefix.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(k) for k in KEY), "conv_id", "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = stage(inner.unionByName(root), "nodes")
    reached = prefix.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end"))
    ends = convs.join(reached, "conv_id", "left").select(*(F.coalesce(f"end.{k}", zero).alias(k) for k in KEY), "conv_id")

    # children next to each other: the parent's smallest member, its depth, the own smallest member
    up = (F.col("depth") - 1).alias("depth")
    above = nodes.where("depth > 0").groupBy(up, F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")).join(above, KEY)
    parents = stage(parents.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), "parent_conv_id", "n_children"), "parents")
    below = join_unique(nodes.where("depth > 0"), parents, ["depth", "p1", "p2"], "n_children")
    rows = below.select(*KEY, "conv_id", "n_convs", "bytes", "parent_conv_id").unionByName(nodes.where("depth = 0").select(*KEY, "conv_id", "n_convs", "bytes", none.alias("parent_conv_id")))
    order = [F.col("parent_conv_id").asc_nulls_first(), F.col("depth"), F.col("conv_id")]
    rows = stage(running(rows.withColumn("all", F.lit(0)), order, ["all"], "v long", (-1,), lambda s, _: (s[0] + 1,), lambda a, b: (a[0] + b[0] + 1,), "numbers"), "numbered")

    # arcs 2v into v and 2v + 1 out of it
    span = rows.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), up).agg(F.min("v").alias("first_child"), F.max("v").alias("last_child"), F.count("*").alias("n_children"))
    known = stage(rows.join(span, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "known")
    over = known.where("n_children > 0").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("v").alias("parent_v"), F.col("last_child").alias("last"), F.col("n_children").alias("uses"))
    placed = join_unique(known.where("depth > 0").select("conv_id", "depth", "parent_conv_id", "v", "first_child"), over, ["parent_conv_id", "depth"], "uses")
    placed = placed.select("conv_id", "depth", "v", "first_child", "parent_v", "last").unionByName(known.where("depth = 0").select("conv_id", "depth", "v", "first_child", none.alias("parent_v"), none.alias("last")))
    enter = F.struct((F.col("v") * 2).alias("id"), F.coalesce(F.col("first_child") * 2, F.col("v") * 2 + 1).alias("next"))
    leave = F.struct((F.col("v") * 2 + 1).alias("id"), F.when(F.col("v") < F.col("last"), F.col("v") * 2 + 2).otherwise(F.col("parent_v") * 2 + 1).alias("next"))
    arcs = placed.select("conv_id", "depth", F.explode(F.array(enter, leave)).alias("arc")).select("conv_id", "depth", "arc.id", "arc.next")
    places = list_rank(arcs, ["conv_id", "depth", "id"], 2 * known.count())

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    values = known.select("v", leaf.alias("leaf"), saved.alias("saved"))
    tour = places.select("place", F.shiftright("id", 1).alias("v"), (F.col("id") % 2 == 0).alias("enters")).join(values, "v")
    tour = tour.select("place", "v", F.when(F.col("enters"), F.col("leaf")).otherwise(0).alias("leaf"), F.when(F.col("enters"), F.col("saved")).otherwise(0).alias("saved"), F.lit(0).alias("all"))
    sums = running(tour, ["place"], ["all"], "leaves long, savings long", (0, 0), lambda s, r: (s[0] + r[2], s[1] + r[3]), lambda a, b: (a[0] + b[0], a[1] + b[1]), "tour_sums")
    within = lambda total, first: (F.max(total) - F.min(total) + F.max(first)).alias(total)  # noqa: E731  sums never fall
    subtree = sums.groupBy("v").agg(within("leaves", "leaf"), within("savings", "saved"))

    hashes = member_hashes(ends)
    out = known.join(subtree, "v").join(hashes, KEY, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("savings").alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return trie(spark.read.parquet(f"{folder}/conversations.parquet"))


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda x, v: xor(xor(x, v) >> 1, 3988292384 * (xor(x, v) & 1))), 4294967295)"""

OP13_SQL = f"""
WITH o AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(t ORDER BY i) AS turns FROM o GROUP BY conv_id),
c AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS base, CAST({_CRC} % 9 AS INTEGER) AS h FROM l),
r AS (SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM c LEFT JOIN l AS b ON b.conv_id = c.base),
p AS (SELECT conv_id, d, turns[1:d] AS pre, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT pre, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY pre, d),
k AS (SELECT pre[1:depth - 1] AS pre, CAST(count(*) AS BIGINT) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth > 0 THEN strlen(n.pre[-1].text) ELSE 0 END AS own FROM n LEFT JOIN k USING (pre)),
s AS (SELECT pre[1:a] AS pre, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
  FROM (SELECT pre, n_children, own, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (pre) LEFT JOIN n AS u ON m.depth > 0 AND u.pre = m.pre[1:m.depth - 1]
"""
