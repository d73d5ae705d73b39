"""Ranked lexical search over bit-sliced Bloom signatures, exact in its result.

Index. Each document is a column of bits: for every term, ``HASHES`` slots, and as many for each of ``LEVELS`` that the
term's count reaches. Columns of documents of like vocabulary are kept together, so that a signature has about
``BITS`` bits a key whatever the text's length, and turned by 90 degrees: a block holds one row of bits per slot. The
index knows neither queries nor weights; it also counts the documents of each term.

Search. The rows of a term's slots, intersected, are the documents that may hold it: all that do, and a few more. Per
level, summed with the terms' weights, and turned to scores by each document's length, they bound its score from
above. The documents with the highest bounds are scored first, some times k; the k-th best of those is the query's floor. Then all
documents whose bound reaches it, by score and then by id, are scored exactly on their whole text. What is left out is
proven to come later.

Scores are integers, as ``score`` says. Queries are shipped to the tasks by ``SHIPPED_BYTES`` of text, one search each;
a task keeps one block and the rows of ``TOGETHER`` terms. Of documents with equal texts, which score alike, a query
needs those with the k smallest ids only, so copies are scored k times at most.

Defined results: null texts and texts without a term have no term, are not counted and are never found. Queries without
terms, or of terms that no document holds, find nothing. Rows that repeat an id, or all columns, are documents (or queries)
of their own. Of equal scores the smaller id comes first, null last. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serupa.llm.batches import slices
from serupa.llm.decontaminate import words_of
from serupa.session import read_table, stage

LEVELS = (1, 2, 3, 5, 9)  # counts of a term in a text that a signature tells apart
HASHES = 4
BITS = 12  # a key, at least; slots are a power of two
LEAST_SLOTS = 512
BLOCK_DOCS = 4096
BLOCK_BITS = 1 << 23
HELD_TERMS = 1 << 18  # terms counted in a task before it passes them on
SHIPPED_BYTES = 2 << 20  # text of the queries that one search answers
FIRST = 8  # times k documents of highest bounds are scored for the floor
TOGETHER = 1 << 13  # terms looked up in a block at once
BROADCAST_BYTES = 64 << 20  # candidates shipped to the tasks that read the texts
_INDEX = "slots int, docs int, words long, ids binary, nulls binary, digests binary, lengths binary, bits binary, terms array<binary>, df array<long>"
_SCHEMA = pa.schema(
    [("slots", pa.int32()), ("docs", pa.int32()), ("words", pa.int64())]
    + [(n, pa.binary()) for n in ("ids", "nulls", "digests", "lengths", "bits")]
    + [("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int64()))]
)


def score(terms: dict[bytes, int], n: int, weights: dict[bytes, int], documents: int, words: int) -> int:
    """Score of a text with the counts ``terms`` and ``n`` words; ``weights`` of the query's terms include repeats."""
    middle = 12 * (75 + 25 * n * documents // words)
    return sum(w * (1_000_000_000 * terms[t] // (1000 * terms[t] + middle)) for t, w in weights.items() if t in terms)


def hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))


def _slots(codes: np.ndarray, level: np.ndarray | int, slots: int) -> np.ndarray:
    """(keys, HASHES) slots of keys (hash of a term, level)."""
    with np.errstate(over="ignore"):
        x = codes[:, None] + (np.asarray(level, np.uint64)[..., None] * np.uint64(HASHES) + np.arange(1, HASHES + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(slots - 1)).astype(np.int64)


class _Blocks:
    """Blocks under construction, by number of slots."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}

    def add(self, counts: Counter, n: int, key: int | None, digest: bytes):
        """The row of the block that this document has filled, if any."""
        codes, tf = hashed(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        level = np.searchsorted(LEVELS, tf, "right")
        at = np.repeat(np.arange(len(tf)), level)
        number = np.arange(len(at)) - np.repeat(np.cumsum(level) - level, level)
        slots = max(LEAST_SLOTS, 1 << int(len(at) * BITS - 1).bit_length())
        docs = self.held.setdefault(slots, [])
        docs.append((key, digest, n, np.unique(_slots(codes[at], number, slots))))
        if len(docs) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // slots)):
            return self.row(slots)
        return None

    def row(self, slots: int) -> dict:
        docs = self.held.pop(slots)
        table = np.zeros((slots, len(docs)), np.uint8)
        for i, (_, _, _, at) in enumerate(docs):
            table[at, i] = 1
        keys = np.array([k or 0 for k, _, _, _ in docs], np.int64)
        nulls = np.packbits([k is None for k, _, _, _ in docs])
        lengths = np.array([n for _, _, n, _ in docs], np.int64)
        return {
            "slots": slots, "docs": len(docs), "words": int(lengths.sum()), "ids": keys.tobytes(), "nulls": nulls.tobytes(),
            "digests": b"".join(d for _, d, _, _ in docs), "lengths": lengths.tobytes(), "bits": np.packbits(table, axis=1).tobytes(),
        }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of signatures, and rows of terms with the number of documents that hold them: one pass, no shuffle."""

    def build(batches):
        blocks, df = _Blocks(), Counter()
        row = lambda fields: pa.RecordBatch.from_pylist([fields], _SCHEMA)
        counted = lambda: row({"docs": 0, "words": 0, "terms": list(df), "df": list(df.values())})
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for start, stop in slices(texts):
                ids = batch.column(0).slice(start, stop - start).to_pylist()
                for k, raw in zip(ids, texts.slice(start, stop - start).to_pylist(), strict=True):
                    words = words_of(raw)
                    if not words:
                        continue
                    counts = Counter(words)
                    df.update(counts.keys())
                    full = blocks.add(counts, len(words), k, md5(raw).digest())
                    if full:
                        yield row(full)
                    if len(df) >= HELD_TERMS:
                        yield counted()
                        df.clear()
        for slots in sorted(blocks.held):
            yield row(blocks.row(slots))
        if df:
            yield counted()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(build, _INDEX)


@dataclass
class Queries:
    """Queries as rows of (term, weight), shipped to the tasks."""

    terms: list[bytes]
    start: np.ndarray  # of each query's terms in ``term``
    term: np.ndarray  # numbers of its distinct terms
    weight: np.ndarray  # weight times repeats
    documents: int
    words: int
    codes: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], df: dict[bytes, int], documents: int, words: int) -> Queries:
        number = {t: i for i, t in enumerate(sorted(df))}
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        rows = [[(number[t], weight[t] * n) for t, n in sorted(Counter(words_of(x)).items()) if weight.get(t, 0) > 0] for x in texts]
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
        start = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        return cls(list(number), start, flat[:, 0], flat[:, 1], documents, words, hashed(list(number)))

    def weights(self, query: int) -> dict[bytes, int]:
        at = slice(self.start[query], self.start[query + 1])
        return {self.terms[t]: int(w) for t, w in zip(self.term[at], self.weight[at], strict=True)}

    def parts(self):
        """Ranges of queries with at most about ``TOGETHER`` terms."""
        a = 0
        while a < len(self.start) - 1:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + TOGETHER, "right")) - 1)
            yield a, b
            a = b

    def bounds(self, block: dict):
        """(query, bound of each document of the block as a double)."""
        slots, docs = block["slots"], block["docs"]
        bits = np.frombuffer(block["bits"], np.uint8).reshape(slots, -1)
        n = np.frombuffer(block["lengths"], np.int64)
        middle = 12 * (75 + (25 * n.astype(object) * self.documents // self.words).astype(np.int64))
        most = np.minimum(np.array([*(x - 1 for x in LEVELS[1:]), 1 << 32])[:, None], n)  # count behind each level
        gain = np.diff(1_000_000_000 * most // (1000 * most + middle), axis=0, prepend=0).astype(float)
        for a, b in self.parts():
            own = slice(self.start[a], self.start[b])
            terms, at = np.unique(self.term[own], return_inverse=True)
            rows, alive = [], np.arange(len(terms))
            for level in range(len(LEVELS)):
                found = np.bitwise_and.reduce(bits[_slots(self.codes[terms[alive]], level, slots)], axis=1)
                if level:
                    found &= rows[-1][1][rows[-1][0][alive]]
                some = found.any(axis=1)
                alive, found = alive[some], found[some]
                where = np.full(len(terms), -1)
                where[alive] = np.arange(len(alive))
                rows.append((where, found))
                if not len(alive):
                    break
            for query in range(a, b):
                mine = slice(self.start[query] - self.start[a], self.start[query + 1] - self.start[a])
                number, weight = at[mine], self.weight[own][mine].astype(float)
                bound = np.zeros(docs)
                for level, (where, found) in enumerate(rows):
                    row = where[number]
                    held = row >= 0
                    if not held.any():
                        break
                    bound += gain[level] * (weight[held] @ np.unpackbits(found[row[held]], axis=1, count=docs))
                if weight.sum() * 1e6 >= 2**53:  # below, all sums are exact
                    bound *= 1 + 1e-9
                yield query, bound


_CANDIDATE = "query int, id long, digest binary, bound double"


def _candidate_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.float64()), strict=True)], ["query", "id", "digest", "bound"])


def _documents(block: dict):
    nulls = np.unpackbits(np.frombuffer(block["nulls"], np.uint8), count=block["docs"]).astype(bool)
    return np.frombuffer(block["ids"], np.int64), nulls, lambda i: block["digests"][16 * i : 16 * i + 16]


def _better(bound, ids, nulls, score, key):
    """Which documents may still come before (score, key) or are it; a null key is behind all others."""
    return (bound > score) | (bound == score) & ((key is None) | ~nulls & (ids <= (key or 0)))


def _candidates(blocks: DataFrame, queries: Queries, k: int, floors: list | None) -> DataFrame:
    """Documents by bound: without ``floors`` a query's FIRST * k best, of each task k; else all that may reach its (score, id)."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, floors))

    def highest(batches):
        queries, _ = shared.value
        best: dict[int, list] = {}
        order = lambda r: (-r[3], r[1] is None, r[1])
        for batch in batches:
            for block in batch.to_pylist():
                ids, nulls, digest = _documents(block)
                for query, bound in queries.bounds(block):
                    held = best.setdefault(query, [])
                    least = max(held[-1][3] if len(held) == k else 0.0, np.partition(bound, -k)[-k] if len(bound) > k else 0.0)
                    at = np.flatnonzero((bound >= least) & (bound > 0))
                    at = at[np.lexsort((ids[at], nulls[at], -bound[at]))][:k]
                    held += [(query, None if nulls[i] else int(ids[i]), digest(i), float(bound[i])) for i in at.tolist()]
                    held.sort(key=order)
                    del held[k:]
        for held in best.values():
            if held:
                yield _candidate_batch(held)

    def reaching(batches):
        queries, floors = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                ids, nulls, digest = _documents(block)
                order = np.lexsort((ids, nulls))
                out = []
                for query, bound in queries.bounds(block):
                    seen: Counter = Counter()
                    score, key, scored = floors[query]
                    for i in order[_better(bound, ids, nulls, score, key)[order]].tolist():
                        d = digest(i)
                        seen[d] += 1
                        # of equal texts those with the smallest ids, and none whose score is known to be too low
                        if seen[d] <= k and (d not in scored or _better(scored[d], ids[i], nulls[i], score, key)):
                            out.append((query, None if nulls[i] else int(ids[i]), d, float(bound[i])))
                if out:
                    yield _candidate_batch(out)

    found = blocks.mapInArrow(highest if floors is None else reaching, _CANDIDATE)
    if floors is None:
        order = Window.partitionBy("query").orderBy(F.desc("bound"), F.col("id").asc_nulls_last(), "digest")
    else:
        order = Window.partitionBy("query", "digest").orderBy(F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (k * FIRST if floors is None else k)).select("query", "id", "digest")


def _scored(docs: DataFrame, candidates: DataFrame, queries: Queries) -> DataFrame:
    """(query, id, digest, score) of the candidates, on their whole texts: the texts stay where they are while candidates are few."""
    wanted = stage(candidates.groupBy("id", "digest").agg(F.collect_set("query").alias("queries")).withColumnRenamed("id", "own"), "wanted")
    size = wanted.agg(F.sum(F.size("queries").cast("long") * 4 + 64)).first()[0] or 0
    side = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    texts = docs.withColumn("__digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = texts.join(side, (F.col("__digest") == F.col("digest")) & F.col("id").eqNullSafe(F.col("own"))).select("id", "text", "digest", "queries")
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        queries = shared.value
        known: dict[int, dict] = {}
        for batch in batches:
            rows = []
            for key, raw, digest, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(raw)
                counts = Counter(words)
                for q in asked:
                    if q not in known:
                        known[q] = queries.weights(q)
                    rows.append((q, key, digest, score(counts, len(words), known[q], queries.documents, queries.words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["query", "id", "digest", "score"])

    return joined.mapInArrow(work, "query int, id long, digest binary, score long").where("score > 0")


def _search(docs: DataFrame, index: DataFrame, texts: list[bytes], k: int, totals: tuple[int, int]) -> DataFrame:
    """(query, rank, id, score) of queries that fit ``SHIPPED_BYTES``."""
    spark = docs.sparkSession
    vocabulary = sorted({t for x in texts for t in words_of(x)})
    asked = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary"))
    terms = index.where("docs = 0").select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = {bytes(t): n for t, n in terms.join(asked, "term").groupBy("term").agg(F.sum("df")).collect()}  # of the queries' own terms
    queries = Queries.build(texts, df, *totals)
    blocks = index.where("docs > 0").drop("terms", "df")
    first = _scored(docs, stage(_candidates(blocks, queries, k, None), "first"), queries)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    floors: list = [(1.0, None, {}) for _ in texts]  # the k-th best (score, id), and scores by text: k a query
    for query, digest, value, key, place in first.select("query", "digest", "score", "id", F.row_number().over(rank).alias("place")).where(F.col("place") <= k).collect():
        scored = floors[query][2]
        scored[bytes(digest)] = value
        if place == k:
            floors[query] = (value, key, scored)
    found = _scored(docs, stage(_candidates(blocks, queries, k, floors), "reaching"), queries)
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(``query_key``, rank, ``key``, score): the ``k`` documents of each query that score highest above zero.

    Builds the index of ``docs`` unless one, made of the same rows, is given.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    index = index if index is not None else stage(build_index(rows, "id"), "signatures")
    documents, words = (x or 0 for x in index.agg(F.sum("docs"), F.sum("words")).first())
    asked = queries.select(F.col(query_key).alias("item"), F.col(query_text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // SHIPPED_BYTES + 1
    found = None
    item = queries.schema[query_key].dataType
    for part in range(parts if documents else 0):
        own = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()  # about SHIPPED_BYTES
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], f"query int, item {item.simpleString()}")
        one = _search(rows, index, [(r["text"] or "").encode() for r in own], k, (documents, words)).join(F.broadcast(names), "query")
        one = one.select(F.col("item").alias(query_key), "rank", F.col("id").alias(key), "score")
        found = one if found is None else found.unionByName(stage(one, f"ranked{part}"))
    return found if found is not None else spark.createDataFrame([], f"{query_key} {item.simpleString()}, rank int, {key} long, score long")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(read_table(spark, folder, "documents").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))


def _terms(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS t FROM documents),
l AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS words FROM l),
q AS (SELECT row_number() OVER () AS q, item_id, {_terms("text")} AS t FROM benchmark),
u AS (SELECT q, term, CAST(count(*) AS BIGINT) AS repeats FROM (SELECT q, unnest(t) AS term FROM q) GROUP BY q, term),
f AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM l) WHERE term IN (SELECT term FROM u) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, documents),
c AS (SELECT u.q, f.r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // words)))) AS BIGINT) AS score
      FROM u JOIN f USING (term) JOIN w USING (term) JOIN l ON l.r = f.r, s GROUP BY u.q, f.r),
p AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c JOIN l USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM p JOIN q USING (q) WHERE rank <= 20
"""
