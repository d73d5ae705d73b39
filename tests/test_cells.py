"""Search by trained cells against brute force: exact by bounds, recall and share of pairs by probing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import DIM, asked, brute, result, vectors

from serupa.config import Settings
from serupa.operators import cells
from serupa.operators.cells import topk_cosine_cells
from serupa.operators.topk import topk_cosine


@pytest.mark.parametrize("tile_rows", [16_384, 23])
@pytest.mark.parametrize("floor", [-2.0, 0.3])
def test_bounds_give_the_full_search(spark, tile_rows, floor):
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw)
    got = result(topk_cosine_cells(queries.withColumn("floor", F.lit(floor)), corpus, DIM, exact=True, settings=Settings(tile_rows=tile_rows)))
    assert got == brute(raw, [(q, np.array(v), k, t, x) for q, v, k, t, x in rows], floor)


def test_probing_is_exact_on_what_it_finds(spark):
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw)
    got = result(topk_cosine_cells(queries, corpus, DIM, settings=Settings(tile_rows=40)))
    cosine = {(q, i): c for q, i, _, c in brute(raw, [(q, np.array(v), 300, t, x) for q, v, k, t, x in rows])}
    assert got and all(cosine[q, i] == c for q, i, _, c in got)


def table(spark, raw):
    rows = [(i, f"v{i:05d}", [float(x) for x in raw[i]]) for i in range(len(raw))]
    return spark.createDataFrame(rows, "query_id BIGINT, id STRING, embedding ARRAY<DOUBLE>").withColumn("exclude_id", F.col("id")).repartition(4)


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.15 * rng.standard_normal((n, dim))


def searched(spark, raw, exact, **settings):
    rows, dim = table(spark, raw), raw.shape[1]
    compared = spark.sparkContext.accumulator(0)
    got = result(topk_cosine_cells(rows, rows.drop("exclude_id", "query_id"), dim, 5, exact=exact, settings=Settings(**settings), compared=compared))
    want = result(topk_cosine(rows, rows.drop("exclude_id", "query_id"), dim, 5))
    return got, want, compared.value / len(raw) ** 2


@pytest.mark.parametrize("tile_rows", [16_384, 300])
def test_clusters_are_pruned(spark, tile_rows):
    """Bounds open few of the pairs where vectors cluster, probing fewer still."""
    raw = clustered(3000, 32, 60, 3)
    got, want, share = searched(spark, raw, True, tile_rows=tile_rows)
    assert got == want and share <= 0.2
    got, want, share = searched(spark, raw, False, tile_rows=tile_rows)
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.9 * len(want) and share <= 0.1


def test_small_cells_share_products():
    """Neighbouring cells that mostly the same queries look at are one product; others keep their own."""
    cell, marks = np.repeat(np.arange(40), 3), np.zeros((1000, 40), bool)
    marks[:, :20], marks[:10, 20:] = True, True
    marks[10, 3] = False
    packed = np.packbits(marks, axis=1)
    met = np.zeros((1000, len(cell)), int)
    runs = list(cells._runs(packed, cell, wide=True))
    for start, stop, rows in runs:
        met[rows, start:stop] += 1
    assert len(runs) == 2 and met.max() == 1 and (met >= marks[:, cell]).all()
    assert len(list(cells._runs(packed, cell, wide=False))) == 40


def test_recall_without_clusters(spark):
    """Directions without any structure are the worst case of cells."""
    raw = np.random.default_rng(5).standard_normal((3000, 32))
    got, want, share = searched(spark, raw, False)
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.9 * len(want) and share <= 0.2
    got, want, _ = searched(spark, raw[:800], True)
    assert got == want


def test_one_cell_holds_most_rows(spark):
    rng = np.random.default_rng(8)
    raw = np.concatenate([np.eye(1, 16) + 1e-3 * rng.standard_normal((700, 16)), rng.standard_normal((200, 16)), np.zeros((3, 16))])
    got, want, _ = searched(spark, raw, True, tile_rows=50)
    assert got == want


def test_tiles_cover_cells(spark):
    raw = clustered(500, 8, 5, 1)
    _, layout = cells.store(table(spark, raw).withColumn("document_type", F.lit(None).cast("string")), 8, 500, 5, settings=Settings(tile_rows=60))
    assert layout.size.sum() == 500
    rows = np.zeros(int((layout.first + layout.tiles).max()))
    for first, tiles, size in zip(layout.first, layout.tiles, layout.size, strict=True):
        rows[first : first + tiles] += size / max(tiles, 1)
    assert (rows > 0).all() and rows.max() <= 60


def test_odd_vectors(spark):
    corpus = spark.createDataFrame([("a", None), ("b", [1.0, 0.0]), ("c", [0.0, 0.0])], "id STRING, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None), ("z", [0.0, 0.0])], "query_id STRING, embedding ARRAY<FLOAT>")
    for exact in (True, False):
        got = {(r.query_id, r.id, r.cosine) for r in topk_cosine_cells(queries, corpus, 2, k=3, exact=exact).collect()}
        assert got == {("q", "b", 1.0), ("q", "c", 0.0), ("z", "b", 0.0), ("z", "c", 0.0)}
        assert topk_cosine_cells(queries, corpus.limit(0), 2, k=3, exact=exact).collect() == []
        assert topk_cosine_cells(queries.limit(0), corpus, 2, k=3, exact=exact).collect() == []
    wide = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 0.0, 1.0, 0.0])], "id STRING, embedding ARRAY<FLOAT>")
    with pytest.raises(Exception, match="width"):
        topk_cosine_cells(queries, wide, 2, k=1, exact=True).collect()
