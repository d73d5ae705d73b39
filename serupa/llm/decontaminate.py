"""Benchmark passages inside documents: a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of an item (a shorter item is one window). As a set, a window
consists of its word pairs. Containment must be full, so the necessary prefix of a window, its pairs
ordered from rare to frequent in all documents, is its first pair: a document that lacks it cannot hold
the window. Documents are probed with their pairs; positional and length bounds drop those places where
the window would not fit, and the rest is compared word by word.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lowered.

Defined results: a null or wordless text has no words and no hits, and is not contaminated. Null or
wordless items take no part. The windows of items without id hit words like others; only the list of items lacks them. Items that repeat an id share it; equal windows of
several items count for each. Repeated documents get equal rows. An empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.session import stage

CHUNK_BYTES = 8 << 20  # benchmark text shipped to the tasks at once
CANDIDATES = 1 << 18  # places compared at once
_WORD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


@dataclass
class Windows:
    """Distinct windows of some items as word numbers, 0 where a window is shorter than the longest."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # (windows, longest)
    length: np.ndarray
    items: list[list[str]]  # of each window
    anchor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # code of the rarest pair
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # its place in the window

    @classmethod
    def build(cls, rows, window: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text.encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        longest = max(map(len, found), default=1)
        words = np.zeros((len(found), longest), np.int64)
        for i, w in enumerate(found):
            words[i, : len(w)] = w
        return cls(vocabulary, words, np.array([len(w) for w in found], np.int64), [sorted(i for i in x if i is not None) for x in found.values()])

    def pairs(self) -> np.ndarray:
        """(windows, pairs) codes, -1 behind a window's end. The one pair of a one-word window has no second word."""
        following = np.zeros_like(self.words)
        following[:, :-1] = self.words[:, 1:]
        real = np.arange(self.words.shape[1]) < np.maximum(self.length - 1, 1)[:, None]
        return np.where(real, self.words * self.base + following, -1)

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def choose(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Anchor each window at its rarest pair, by the counts of all documents; ties to the lower code."""
        pairs = self.pairs()
        rarity = np.full(pairs.shape, np.iinfo(np.int64).max)
        real = pairs >= 0
        at = np.searchsorted(codes, pairs[real])
        rank = np.empty(len(codes), np.int64)
        rank[np.lexsort((codes, counts))] = np.arange(len(codes))
        rarity[real] = rank[at]
        self.offset = rarity.argmin(axis=1)
        self.anchor = pairs[np.arange(len(pairs)), self.offset]


def _numbered(texts, vocabulary):
    """Word numbers of all texts in one array, and where each text starts."""
    get = vocabulary.get
    ids, starts = [], [0]
    for text in texts:
        ids += [get(w, 0) for w in words_of(text)]
        starts.append(len(ids))
    return np.array(ids, np.int64), np.array(starts, np.int64)


def _codes(ids, starts, base):
    """Pair code at each place; a text's last word has no second word. Unknown words give no pair."""
    following = np.zeros_like(ids)
    following[:-1] = ids[1:]
    ends = starts[1:][starts[1:] > starts[:-1]] - 1
    following[ends] = 0
    return np.where((ids > 0) & (following > 0), ids * base + following, -1), np.where(ids > 0, ids * base, -1)


def _pair_counts(docs: DataFrame, text: str, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """How often all documents hold each pair of the windows."""
    pairs = windows.pairs()
    codes = np.unique(pairs[pairs >= 0])
    vocabulary, base, single = windows.vocabulary, windows.base, bool((windows.length == 1).any())
    shared = docs.sparkSession.sparkContext.broadcast((codes, vocabulary))

    def count(batches):
        codes, vocabulary = shared.value
        total = np.zeros(len(codes) + 1, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.binary())
            for i in range(0, len(column), 256):
                ids, starts = _numbered(column.slice(i, 256).to_pylist(), vocabulary)
                for found in _codes(ids, starts, base)[: 1 + single]:
                    found = found[found >= 0]
                    at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                    total += np.bincount(np.where(codes[at] == found, at, len(codes)), minlength=len(total))
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(codes), np.int64)
    for row in counted.collect():  # at most one row per pair of this chunk of the benchmark
        counts[row["pair"]] = row["n"]
    return codes, counts


def _find(ids, starts, w: Windows, order, anchors):
    """(text, start, end, window) of all places where a window stands."""
    both, one = _codes(ids, starts, w.base)
    out = []
    for codes in (both, one) if (w.length == 1).any() else (both,):
        place = np.flatnonzero(codes >= 0)
        lo, hi = np.searchsorted(anchors, codes[place], "left"), np.searchsorted(anchors, codes[place], "right")
        place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
            flat = np.arange(a, min(a + CANDIDATES, int(ends[-1])))
            at = np.searchsorted(ends, flat, "right")
            window = order[lo[at] + flat - (ends[at] - n[at])]
            start = place[at] - w.offset[window]
            doc = np.searchsorted(starts, place[at], "right") - 1
            fits = (start >= starts[doc]) & (start + w.length[window] <= starts[doc + 1])
            window, start, doc = window[fits], start[fits], doc[fits]
            columns = np.arange(w.words.shape[1])
            inside = np.minimum(start[:, None] + columns, len(ids) - 1)
            same = ((ids[inside] == w.words[window]) | (columns >= w.length[window][:, None])).all(axis=1)
            out.append((doc[same], start[same], (start + w.length[window])[same], window[same]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def _scan(docs: DataFrame, text: str, windows: Windows, keep: list[str], also: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def work():
        w = shared.value
        order = np.argsort(w.anchor, kind="stable")
        anchors = w.anchor[order]

        def fn(texts, spans=None, items=None):
            ids, starts = _numbered(texts, w.vocabulary)
            doc, start, end, window = _find(ids, starts, w, order, anchors)
            step = np.zeros(len(ids) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, end, -1)
            if spans is not None:
                for i, s in enumerate(spans.to_pylist()):
                    np.add.at(step, starts[i] + np.array(s[::2], np.int64), 1)
                    np.add.at(step, starts[i] + np.array(s[1::2], np.int64), -1)
            covered = np.cumsum(step[:-1]) > 0
            hit = np.concatenate([[0], np.cumsum(covered)])
            names: list[set] = [set(x) for x in items.to_pylist()] if items is not None else [set() for _ in texts]
            for d, v in set(zip(doc.tolist(), window.tolist(), strict=True)):
                names[d].update(w.items[v])
            ranges = []
            for i in range(len(texts)):
                edge = np.diff(np.concatenate([[0], covered[starts[i] : starts[i + 1]].astype(np.int8), [0]])) if hit[starts[i + 1]] > hit[starts[i]] else np.zeros(0)
                up, down = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                ranges.append(np.stack([up, down], 1).ravel().tolist())
            return [
                np.diff(starts), hit[starts[1:]] - hit[starts[:-1]],
                pa.array(ranges, pa.list_(pa.int64())), pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            ]

        return fn

    return map_text(docs, "n_words long, n_hit long, hit_ranges array<long>, items array<string>", work, keep, text, also)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", passage: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_hit (words inside a window's occurrence), hit_ranges
    (their first word and the word behind the last, flat), items (ids, sorted as strings) and contaminated:
    at least one word in ``share`` is hit.

    The benchmark is shipped to the tasks in chunks of about ``CHUNK_BYTES`` of text, one pass each.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(passage).cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = size // CHUNK_BYTES + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(chunks))
    found, wanted = docs, keep
    for i in range(chunks):
        windows = Windows.build(rows.where(part == i).toLocalIterator(), window)
        if len(windows.length):
            windows.choose(*_pair_counts(docs, text, windows))
        last = i == chunks - 1
        found = _scan(found, text, windows, wanted if last else [*wanted, text], ["hit_ranges", "items"] if i else [])
        if not last:
            found = stage(found, f"contamination{i}")
    hit = F.col("n_hit")
    return found.withColumn("contaminated", (hit > 0) & (share * hit >= F.col("n_words")))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def _word_list(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_word_list("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_word_list("text")} AS w FROM benchmark),
v AS (SELECT DISTINCT item, w[i:i + least(13, len(w)) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM v),
p AS (SELECT r, i, n, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS i FROM d, l)),
h AS (SELECT p.r, p.i, p.n, v.item FROM p JOIN v ON p.win = v.win),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
