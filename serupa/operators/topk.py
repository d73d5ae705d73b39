"""Top-k cosine nearest neighbours of many queries in a table of vectors.

Exact search, two physical forms with the same result:

* query vectors that fit a checked byte limit are sent to every task, and the corpus is scanned once
  without a shuffle, each task keeping its best k per query;
* larger query tables are tiled: rows are spread by a hash of their unique id, so tiles have equal size
  whatever the data looks like, and each (query tile, corpus tile) meets in one bounded task. A side is copied
  once per tile of the other, so the copies grow with the square of the rows: beyond a limit that grows with the
  rows, the queries are searched in rounds, and a round's copies are deleted before the next.

Either way a task emits at most k rows per query, never all pairs, and a window picks the final k.
``operators.cells`` has the forms that look at a part of the corpus only.

The tiled form first collapses copies, which loses nothing: equal query vectors are searched once, and
of equal corpus vectors only the first k + 1 ids can ever be a result (one may be the excluded id).

Ranking is by the cosine snapped to 1e-10, then by id; summation order cannot change a result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serupa.config import DEFAULTS, Settings
from serupa.operators.skew import join_unique
from serupa.session import stage, stage_alone

NO_FLOOR = -2.0
_CHUNK = 2048  # rows of one side per matrix product
_HELD = 1 << 20  # pairs found before they are cut to the best k
_MAX_TASKS = 50_000
_OUT = "query_id {qid}, top_k INT, id STRING, cosine DOUBLE"


@dataclass
class _Side:
    ids: np.ndarray
    raw: np.ndarray  # vectors as they were given
    norm: np.ndarray
    types: np.ndarray
    top_k: np.ndarray | None = None
    exclude: np.ndarray | None = None
    floor: np.ndarray | None = None

    def unit(self, rows=slice(None)) -> np.ndarray:
        """Unit vectors in double precision; zero for a zero vector."""
        raw, norm = self.raw[rows].astype(np.float64), self.norm[rows, None]
        return np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)

    @cached_property
    def single(self) -> np.ndarray:
        """Unit vectors in single precision, made in slices."""
        out = np.empty(self.raw.shape, np.float32)
        for i in range(0, len(out), _CHUNK):
            out[i : i + _CHUNK] = self.unit(slice(i, i + _CHUNK))
        return out


def _objects(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _side(data: pa.Table | pa.RecordBatch, query: bool, dim: int) -> _Side:
    # Rows without a vector are skipped here: a filter would be pushed down and compute every vector twice.
    if data.column("embedding").null_count:
        data = data.filter(data.column("embedding").is_valid())
    column = data.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = np.diff(column.offsets.to_numpy())
    if (widths != dim).any():
        raise ValueError(f"vectors of width {dim} expected, found one of width {widths[widths != dim][0]}")
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    norm = np.empty(len(raw))
    for i in range(0, len(raw), _CHUNK):
        norm[i : i + _CHUNK] = np.sqrt(np.square(raw[i : i + _CHUNK].astype(np.float64)).sum(axis=1))
    types = _objects(data.column("document_type"))
    if not query:
        return _Side(_objects(data.column("id")), raw, norm, types)
    return _Side(
        data.column("query_id").to_pandas().to_numpy(),
        raw,
        norm,
        types,
        data.column("top_k").to_numpy(zero_copy_only=False) if isinstance(data, pa.RecordBatch)
        else data.column("top_k").to_numpy(),
        _objects(data.column("exclude_id")),
        data.column("floor").to_pandas().to_numpy(dtype=np.float64),
    )


def _in_id_order(c: _Side) -> _Side:
    order = np.argsort(c.ids, kind="stable")
    return _Side(c.ids[order], c.raw[order], c.norm[order], c.types[order])


def _snapped(cosine: np.ndarray) -> np.ndarray:
    np.multiply(cosine, 1e10, out=cosine)
    np.add(cosine, 0.5, out=cosine)
    np.floor(cosine, out=cosine)
    return np.divide(cosine, 1e10, out=cosine)


class _Pairs:
    """Cosines of the pairs of two sides that can count; ``c`` has equal cosines in id order."""

    def __init__(self, q: _Side, c: _Side, k: int) -> None:
        self.q, self.c, self.k = q, c, k
        self.wanted = np.array([t is not None and t != "" for t in q.types], bool)
        self.codes = pd.factorize(np.concatenate([q.types, c.types]))[0] if self.wanted.any() else None
        some = any(x is not None for x in q.exclude)
        self.own = pd.Index(c.ids).get_indexer(q.exclude) if some else np.full(len(q.ids), -1)
        # Rounding of both vectors and of the sum, with as much again for the floors.
        self.slack = (q.raw.shape[1] + 8) * 2.0**-23

    def block(self, at: np.ndarray, start: int, stop: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, corpus row and cosine of all pairs that can be among the best k of a query in this block.

        A product in single precision, which is off by less than ``slack``, shows the pairs below a query's floor or
        its k-th best; the others are computed in double precision.
        """
        q, c, k, width = self.q, self.c, self.k, stop - start
        near = q.single[at] @ c.single[start:stop].T
        if self.codes is not None:
            own, theirs = self.codes[: len(q.ids)][at, None], self.codes[None, len(q.ids) + start : len(q.ids) + stop]
            np.putmask(near, (own != theirs) & self.wanted[at, None], -np.inf)
        inside = np.flatnonzero((self.own[at] >= start) & (self.own[at] < stop))
        near[inside, self.own[at[inside]] - start] = -np.inf
        keep = near >= (floor[at, None] - self.slack).astype(np.float32)
        room = 4 * k + 64
        ties = np.zeros(0, int)
        if width > room and np.count_nonzero(keep) > k * len(at):
            crowded = np.flatnonzero(np.count_nonzero(keep, axis=1) > room)
            part = near[crowded]
            kth = np.partition(part, width - k, axis=1)[:, width - k, None]
            keep[crowded] &= part >= kth - np.float32(2 * self.slack)
            ties = crowded[np.count_nonzero(keep[crowded], axis=1) > room]
            keep[ties] = False
        flat = np.flatnonzero(keep)
        rows, cols = np.divmod(flat, width)
        if len(flat) * 64 > keep.size:
            cosine = (q.unit(at) @ c.unit(slice(start, stop)).T).ravel()[flat]
        else:
            cosine = np.empty(len(flat))
            for i in range(0, len(flat), _CHUNK):
                cut = slice(i, i + _CHUNK)
                cosine[cut] = np.einsum("ij,ij->i", q.unit(at[rows[cut]]), c.unit(cols[cut] + start))
        cosine = _snapped(cosine)
        good = cosine >= floor[at[rows]]
        rows, cols, cosine = rows[good], cols[good], cosine[good]
        if len(ties):
            more = self._ties(at[ties], start, stop, floor, near[ties] == -np.inf)
            rows, cols, cosine = (np.concatenate(x) for x in zip((rows, cols, cosine), (ties[more[0]], *more[1:]), strict=True))
        return at[rows], cols + start, cosine

    def _ties(self, at: np.ndarray, start: int, stop: int, floor: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of queries that are about as near to very many rows, by all exact cosines and then by id."""
        k, width = self.k, stop - start
        cosine = _snapped(self.q.unit(at) @ self.c.unit(slice(start, stop)).T)
        cosine[barred] = -np.inf
        keep = cosine >= floor[at, None]
        kth = np.partition(cosine, width - k, axis=1)[:, width - k, None]
        above, tie = cosine > kth, cosine == kth
        keep &= above | (tie & (tie.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
        rows, cols = np.nonzero(keep)
        return rows, cols, cosine[rows, cols]


class _Running:
    """Best k corpus rows of each query so far, rows numbered in id order; raises ``floor``, which the caller shares."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k, self.held = floor, k, 0
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.found: list[tuple] = []

    def add(self, rows: np.ndarray, cols: np.ndarray, cosine: np.ndarray) -> None:
        if len(rows):
            self.found.append((rows, cols, cosine))
            self.held += len(rows)
        if self.held > max(_HELD, len(self.best[0])):
            self.settle()

    def settle(self) -> None:
        if not self.found:
            return
        rows, cols, cosine = (np.concatenate(x) for x in zip(self.best, *self.found, strict=True))
        self.found.clear()
        self.held = 0
        order = np.lexsort((cols, -cosine, rows))
        rows, cols, cosine = rows[order], cols[order], cosine[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], cosine[last])
        self.best = [x[place < self.k] for x in (rows, cols, cosine)]


class _Best:
    """Running best k per query over several parts of a corpus."""

    def __init__(self, q: _Side) -> None:
        self.q = q
        self.k = int(q.top_k.max(initial=1))
        self.floor = q.floor.copy()
        self.rows = pd.DataFrame({"row": pd.Series(dtype="int64"), "id": [], "cosine": pd.Series(dtype="float64")})

    def add(self, corpus: _Side) -> None:
        if not len(corpus.ids) or not len(self.q.ids):
            return
        corpus = _in_id_order(corpus)
        pairs, found = _Pairs(self.q, corpus, self.k), []
        for i in range(0, len(self.q.ids), _CHUNK):
            at = np.arange(i, min(i + _CHUNK, len(self.q.ids)))
            running = _Running(self.floor, self.k)
            settled = 1
            for n, j in enumerate(range(0, len(corpus.ids), _CHUNK), 1):
                running.add(*pairs.block(at, j, min(j + _CHUNK, len(corpus.ids)), self.floor))
                if n >= settled:  # again when twice as many rows were met: the floors then are good for as many more
                    running.settle()
                    settled = 2 * n
            running.settle()
            found.append(running.best)
        self.merge(corpus.ids, found)

    def merge(self, ids: np.ndarray, found: list) -> None:
        """Add the best rows of one part, numbered by their place in its ``ids``."""
        rows, cols, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        new = pd.DataFrame({"row": rows, "id": ids[cols], "cosine": cosine})
        if not len(self.rows):
            self.rows = new
            return
        both = pd.concat([self.rows, new], ignore_index=True).sort_values(["row", "cosine", "id"], ascending=[True, False, True])
        place = both.groupby("row").cumcount()
        self.rows = both[place < self.k]
        last = both[place == self.k - 1]
        at = last["row"].to_numpy(dtype="int64")
        self.floor[at] = np.maximum(self.floor[at], last["cosine"].to_numpy())

    def table(self, schema: pa.Schema) -> pa.Table:
        at = self.rows["row"].to_numpy(dtype="int64")
        return pa.table(
            {
                "query_id": pa.array(self.q.ids[at], schema.field("query_id").type),
                "top_k": pa.array(self.q.top_k[at], pa.int32()),
                "id": pa.array(self.rows["id"].tolist(), pa.string()),
                "cosine": pa.array(self.rows["cosine"].to_numpy(), pa.float64()),
            }
        )


def _out_schema(queries: DataFrame) -> tuple[str, pa.Schema]:
    kind = queries.schema["query_id"].dataType
    ddl = _OUT.format(qid=kind.simpleString())
    id_type = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    if not isinstance(kind, (T.StringType, T.LongType)):
        raise TypeError("query_id must be BIGINT or STRING")
    return ddl, pa.schema([("query_id", id_type)])


def _prepare(queries: DataFrame, corpus: DataFrame, k: int | None, settings: Settings) -> tuple[DataFrame, DataFrame, int, int]:
    """Both sides, the number of queries and the largest ``top_k``."""
    have = set(queries.columns)
    top_k = F.lit(k) if k else F.col("top_k") if "top_k" in have else F.lit(settings.top_k_default)
    q = queries.select(
        "query_id",
        "embedding",
        F.coalesce(top_k.cast("int"), F.lit(settings.top_k_default)).alias("top_k"),
        (F.col("document_type") if "document_type" in have else F.lit(None)).cast("string").alias("document_type"),
        (F.col("exclude_id") if "exclude_id" in have else F.lit(None)).cast("string").alias("exclude_id"),
        F.coalesce((F.col("floor") if "floor" in have else F.lit(None)).cast("double"), F.lit(NO_FLOOR)).alias("floor"),
    )
    c_type = F.col("document_type") if "document_type" in corpus.columns and "document_type" in have else F.lit(None)
    c = corpus.select("id", "embedding", c_type.cast("string").alias("document_type"))
    typed = F.coalesce("document_type", F.lit(""))
    count, most, types = q.agg(F.count("*"), F.max("top_k"), F.slice(F.collect_set(F.when(typed != "", typed)), 1, 100)).first()
    if "document_type" in have and "document_type" in corpus.columns and types and len(types) < 100 and not q.where(typed == "").limit(1).count():
        c = c.where(F.col("document_type").isin(types))  # a stored index then reads those partitions only
    return q, c, count, most or 1


def _final(found: DataFrame, limit: int) -> DataFrame:
    """Best ``top_k`` of each query; ``limit`` is the largest of them."""
    return _ranked(found, limit).drop("top_k")


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    ranked = found.withColumn("semantic_rank", F.row_number().over(best))
    return ranked.where((F.col("semantic_rank") <= limit) & (F.col("semantic_rank") <= F.col("top_k")))


def topk_cosine(
    queries: DataFrame,
    corpus: DataFrame,
    dim: int,
    k: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Exact best ``top_k`` corpus rows of each query: ``query_id, id, cosine, semantic_rank``.

    ``queries``: query_id, embedding and optionally top_k, document_type (null: any), exclude_id and floor,
    the lowest cosine of interest to the query. ``corpus``: id, embedding and optionally document_type.
    All vectors have ``dim`` elements; others raise.
    """
    q, c, count, most = _prepare(queries, corpus, k, settings)
    if count * _bytes_per_query(q, dim) <= settings.broadcast_bytes:
        return _final(_scan_with_broadcast(q, c, dim, settings.rows_a_tile(dim)), most)
    rows = c.count()  # before copies are dropped: an upper bound is enough to size tiles
    return _without_copies(q, c, lambda qs, cs: _tiled(qs, cs, dim, count, rows, settings, most + 1), most)


def _bytes_per_query(q: DataFrame, dim: int) -> int:
    """The vector and the widest id, type and excluded id."""
    texts = [F.octet_length(F.col(c).cast("string")) for c in ("query_id", "document_type", "exclude_id")]
    return dim * 8 + 32 + (q.agg(F.max(sum(F.coalesce(t, F.lit(0)) for t in texts))).first()[0] or 0)


def _scan_with_broadcast(q: DataFrame, c: DataFrame, dim: int, rows: int) -> DataFrame:
    ddl, schema = _out_schema(q)
    block = _side(q.toArrow(), True, dim)  # bounded: the caller checked its bytes
    shared = q.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        best, held = _Best(shared.value), []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                best.add(_side(pa.Table.from_batches(held), False, dim))
                held.clear()
        if held:
            best.add(_side(pa.Table.from_batches(held), False, dim))
        yield from best.table(schema).to_batches()

    return c.mapInArrow(scan, ddl)


def _meet(q: DataFrame, c: DataFrame, keys: list[str], tasks: int, dim: int) -> DataFrame:
    """Best k per query inside each group of equal keys; groups are bounded by the caller.

    The task count is set here: the work per byte is high, so sizing tasks by shuffle bytes would not do.
    """
    ddl, schema = _out_schema(q)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(_side(left, True, dim))
        best.add(_side(right, False, dim))
        return best.table(schema)

    tasks = min(max(tasks, q.sparkSession.sparkContext.defaultParallelism), _MAX_TASKS)
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (q, c)]
    return sides[0].cogroup(sides[1]).applyInArrow(score, ddl)


def _row_bytes(df: DataFrame, dim: int) -> int:
    """About the size of a row that is copied: its vector and its ids."""
    return dim * (4 if isinstance(df.schema["embedding"].dataType.elementType, T.FloatType) else 8) + 64


def _rounds(copied: int, both: int, settings: Settings) -> int:
    """In how many parts queries are searched if all at once make ``copied`` bytes of copies, of ``both`` sides' bytes."""
    return max(1, -(-copied // max(settings.copied_bytes, settings.copied_times * both, 1)))


def _in_rounds(q: DataFrame, rounds: int, limit: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of all queries, or of a part of them at a time; ``limit`` is the largest ``top_k``.

    Of a part only its best rows are kept. What was staged or shuffled for it is gone before the next.
    """
    if rounds == 1:
        return search(q)
    # Another hash than that of tiles, which are to be as even within a part.
    part = lambda n: q.where(F.pmod(F.xxhash64(F.lit("round"), "query_id"), F.lit(rounds)) == n)
    best = lambda n: _ranked(search(part(n)), limit).drop("semantic_rank")
    return reduce(DataFrame.unionByName, [stage_alone(q.sparkSession, lambda n=n: best(n), "round") for n in range(rounds)])


def _tile(key: str, tiles) -> F.Column:
    return F.pmod(F.xxhash64(key), tiles).cast("int")


def _without_copies(q: DataFrame, c: DataFrame, search, limit: int) -> DataFrame:
    """Search distinct query vectors among the first ids of equal corpus vectors, then give every query its hits."""
    cap = limit + 1  # one of them may be excluded
    # A digest stands for its vector: whole vectors are slow to sort and to compare, and need not move to be told apart.
    digest = F.unhex(F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ",", "null"), 256)).alias("same")
    q = stage(q.withColumn("document_type", F.coalesce("document_type", F.lit(""))).select("*", digest), "queries")
    same = ["same", "document_type"]
    groups = q.groupBy(*same).agg(
        F.first("embedding").alias("embedding"), F.min("query_id").alias("query_id"), (F.max("top_k") + 1).alias("top_k"), F.min("floor").alias("floor"),
        F.count("*").alias("uses"),
    )
    groups = stage(groups, "query-groups")
    firsts = Window.partitionBy(*same).orderBy("id")
    kept = c.select("*", digest).withColumn("copy", F.row_number().over(firsts)).where(F.col("copy") <= cap).drop("copy", "same")
    found = search(groups.drop("same").withColumn("exclude_id", F.lit(None).cast("string")), kept)
    best = _final(found, cap)
    lists = best.groupBy("query_id").agg(F.collect_list(F.struct("cosine", "id")).alias("hits"))  # at most k + 1
    answers = stage(groups.select("query_id", *same, "uses").join(lists, "query_id").drop("query_id"), "answers")  # read more than once below
    hits = join_unique(q, answers, same, "uses").select(
        "query_id", "top_k", "exclude_id", "floor", F.inline("hits").alias("cosine", "id")
    )
    own = F.coalesce(F.col("id") == F.col("exclude_id"), F.lit(False))
    return _final(hits.where(~own & (F.col("cosine") >= F.col("floor"))).drop("exclude_id", "floor"), limit)


def _tiled(q: DataFrame, c: DataFrame, dim: int, count: int, rows: int, settings: Settings, limit: int = 1 << 30) -> DataFrame:
    most, cores = settings.rows_a_tile(dim), q.sparkSession.sparkContext.defaultParallelism
    c_tiles = max(1, -(-rows // most))
    q_tiles = max(1, -(-count // most), min(-(-4 * cores // c_tiles), -(-count // _CHUNK)))  # a few tasks a core
    row = _row_bytes(c, dim)
    rounds = min(q_tiles, _rounds((count * c_tiles + rows * q_tiles) * row, (count + rows) * row, settings))
    q_tiles = -(-q_tiles // rounds)  # of a round
    if rounds > 1:
        c = stage(c, "kept")  # read by every round
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def search(q: DataFrame) -> DataFrame:
        q_side = q.withColumn("q_tile", _tile("query_id", F.lit(q_tiles))).withColumn("c_tile", every(c_tiles))
        # Vectors with equal parts pack so well that few tasks read all of them: dealt out again before each is copied per tile.
        c_side = c.repartition(min(q_tiles * c_tiles, 4 * cores), "id").withColumn("c_tile", _tile("id", F.lit(c_tiles))).withColumn("q_tile", every(q_tiles))
        return _meet(q_side, c_side, ["q_tile", "c_tile"], q_tiles * c_tiles, dim)

    return _in_rounds(q, rounds, limit, search)
