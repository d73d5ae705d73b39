"""SimHash near duplicates with deletion-variant signatures.

Fingerprint: XXH64 (UTF-8, seed 42) of each 4-word shingle, repeats included; a bit is 1 if it is set in over
half of them. Words are runs of characters other than white space, A-Z lowered. Texts of fewer words hash
their whole word sequence; wordless and null texts have the fingerprint zero and are linked like any other.

Links: fingerprints that differ in at most 4 bits. They are cut into three segments (21, 21, 22 bits). Of 4
differing bits, one segment holds at most one, so there the two share a variant with that bit deleted. Every
distinct fingerprint is indexed under its 64 variants (segment with one bit deleted), variants are grouped by
equality, and each group is verified with the whole distance. Copies are one fingerprint, so they never meet.

A group gives a spanning forest of its links, not all of them: as many rows as members at most, and the same
components. A group beyond ``TILE`` members is cut into tiles, and each pair of tiles is verified by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.components import components
from serupa.session import stage

BITS = 4
SHINGLE = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
TILE = 1 << 14
TOGETHER = 1 << 17  # shingles of a text hashed at once


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, TOGETHER):
        hashes = [h(line[a:b], SEED) for a, b in zip(first[i : i + TOGETHER], last[i : i + TOGETHER], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints():
    return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and fingerprint (the 64 bits as a long)."""
    return map_text(docs, "fingerprint long", _fingerprints, keep, text)


def _variants(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints under each of their variants; big groups under each pair of tiles."""
    keys = []
    for first, bits in SEGMENTS:
        part = F.shiftrightunsigned("fingerprint", first).bitwiseAND(F.lit((1 << bits) - 1))
        for bit in range(bits):
            keys.append(part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << bit))).bitwiseOR(F.lit((first + bit) << 22)))
    rows = prints.select("fingerprint", F.explode(F.array(*keys)).alias("variant"))
    sizes = rows.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1")
    big = stage(sizes.where(F.col("n") > TILE).select("variant", F.ceil(F.col("n") / TILE).alias("tiles")), "big_groups")
    if big.isEmpty():
        return rows.withColumn("tiles", F.lit(0).cast("long"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("fingerprint"), "tiles")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    cut = rows.join(big, "variant", "left").select("fingerprint", "variant", tiles.alias("tiles")).select("fingerprint", "variant", own.alias("own"), "tiles", other.alias("other"))
    return cut.select("fingerprint", "variant", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("tiles"))


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for every value that is linked to others, by breadth-first search of one group."""
    left, found = values, []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= BITS
            if near.any():
                queue += list(left[near])
                found += [(int(x), int(root)) for x in left[near]]
                left = left[~near]
    return found


def _links(batches):
    """Spanning links of groups that arrive sorted; the last group of a batch waits for the next."""

    def solve(group, values):
        edge = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        size = np.diff(np.concatenate([[0], edge, [len(group)]]))
        first = np.concatenate([[0], edge])
        out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for k in range(2, 9):  # small groups of one size together: all pairs, of which links remain
            members = values[first[size == k][:, None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    near = np.bitwise_count(members[:, i] ^ members[:, j]) <= BITS
                    out_a.append(members[near, j])
                    out_b.append(members[near, i])
        for start, n in zip(first[size > 8], size[size > 8], strict=True):
            if found := _forest(values[start : start + n]):
                pairs = np.array(found, np.uint64)
                out_a.append(pairs[:, 0])
                out_b.append(pairs[:, 1])
        links = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    group, values = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        new = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        group, values = np.concatenate([group, new]), np.concatenate([values, batch.column(2).to_numpy().view(np.uint64)])
        other = np.flatnonzero((group != group[-1]).any(axis=1)) if len(group) else []
        if len(other):
            cut = int(other[-1]) + 1
            yield solve(group[:cut], values[:cut])
            group, values = group[cut:], values[cut:]
    if len(group):
        yield solve(group, values)


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) that span the links between distinct fingerprints (column fingerprint, each once)."""
    keyed = _variants(prints).select("variant", "tiles", "fingerprint").repartition("variant", "tiles").sortWithinPartitions("variant", "tiles")
    return keyed.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns, fingerprint, class_id (the smallest fingerprint that links reach, as a signed number) and
    component_id: the smallest ``key`` among the rows of that class, a row's own included.

    Null keys never become a component_id; it is null where no member has a key. Rows may repeat keys.
    """
    keep = list(dict.fromkeys([*keep, key]))
    rows = stage(fingerprints(docs, keep, text), "fingerprints")
    prints = stage(rows.groupBy("fingerprint").agg(F.min(key).alias("__least")), "prints")
    roots = components(near_links(prints.select("fingerprint")))
    classes = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", "__least", F.coalesce("root", "fingerprint").alias("class_id"))
    least = classes.groupBy("class_id").agg(F.min("__least").alias("component_id"))
    known = stage(classes.join(least, "class_id").select("fingerprint", "class_id", "component_id"), "classes")
    return rows.join(known, "fingerprint")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
