"""Disk of the searches: copies are made in rounds, and what was kept for a table goes once that is written."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cells import clustered, table
from test_search import DIM, asked, brute, documents, result, vectors

from serupa.catalog import registry
from serupa.config import Settings
from serupa.operators import cells, topk
from serupa.operators.cells import topk_cosine_cells
from serupa.operators.encode import HashEncoder
from serupa.operators.index import index_rows
from serupa.operators.topk import topk_cosine
from serupa.plans import check
from serupa.plans.near_duplicates import near_duplicates
from serupa.session import scratch_root, stage, stage_alone


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).rglob("shuffle_*.data")}


def staged(spark, name):
    return list(Path(scratch_root(spark).removeprefix("file:")).rglob(name))


def test_shuffles_go_with_the_write_they_were_made_for(spark):
    before = shuffle_files(spark)
    df = spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    held = stage(df, "counts")
    for _ in range(100):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert held.count() == 1000 and df.count() == 1000  # what was cleared is made again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_what_a_table_was_made_from_goes(spark):
    def make():
        once = stage(spark.range(100), "once-a")
        inner = stage_alone(spark, lambda: stage(once, "once-b").where("id > 9"), "once-c")
        assert not staged(spark, "once-b") and staged(spark, "once-a")
        return inner.union(once)

    own = stage(spark.range(3), "own")
    kept = stage_alone(spark, make, "kept-alone")
    assert kept.count() == 190 and own.count() == 3
    assert staged(spark, "kept-alone") and not any(staged(spark, f"once-{x}") for x in "abc")


@pytest.mark.parametrize("floor", [-2.0, 0.3])
def test_tiles_meet_in_rounds(spark, monkeypatch, floor):
    """All rows against all: copies of a round are bounded by both sides, those of all rounds are not."""
    corpus, raw = vectors(spark)
    queries, rows = asked(spark, raw, 150)
    made, real = [], topk._meet
    monkeypatch.setattr(topk, "_meet", lambda q, c, *how: made.append(q.count() + c.count()) or real(q, c, *how))
    settings = Settings(broadcast_bytes=0, tile_rows=17, copied_bytes=0)
    got = result(topk_cosine(queries.withColumn("floor", F.lit(floor)), corpus, DIM, settings=settings))
    assert got == brute(raw, [(q, np.array(v), k, t, x) for q, v, k, t, x in rows], floor)
    assert len(made) > 3 and sum(made) > 8 * 450
    assert max(made) <= 4 * 450  # twice both sides; a round holds whole tiles and queries are dealt by a hash


@pytest.mark.parametrize("exact", [True, False])
def test_cells_are_visited_in_rounds(spark, monkeypatch, exact):
    raw = np.concatenate([clustered(500, 16, 5, 1), np.random.default_rng(2).standard_normal((500, 16))])
    rows, rounds, real = table(spark, raw), [], cells._in_rounds
    monkeypatch.setattr(cells, "_in_rounds", lambda q, n, *how: rounds.append(n) or real(q, n, *how))

    def found(**options):
        return result(topk_cosine_cells(rows, rows.drop("exclude_id", "query_id"), 16, 5, exact=exact, settings=Settings(tile_rows=60, **options)))

    plain = found()
    assert set(rounds) == {1}
    assert found(copied_bytes=0) == plain
    assert rounds[-1] > 1
    if exact:
        assert plain == result(topk_cosine(rows, rows.drop("exclude_id", "query_id"), 16, 5))


def test_reports_in_rounds_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"kata{i}" for i in range(30)]
    titles = ["padi sawah daun citra"] * 10 + [" ".join(rng.choice(words, n)) for n in (4, 12, 30) for _ in range(12)] + ["", "- -"]
    index = stage(index_rows(documents(spark, [(f"skripsi_{i}", "skripsi", t, None, None) for i, t in enumerate(titles)]), HashEncoder()), "index")
    met, real = [], check.stage
    monkeypatch.setattr(check, "stage", lambda df, name: met.append(name) or real(df, name))

    def report(**options):
        got = near_duplicates(index, HashEncoder(), threshold=0.3, settings=Settings(broadcast_bytes=0, broadcast_rows=0, tile_rows=20, **options))
        return sorted(map(tuple, got.collect()))

    names = ("queries", "query-groups", "kept", "round", "answers")
    held = [len(staged(spark, name)) for name in names]
    plain = report()
    assert met.count("shares") == 1 and len(plain) > 100
    met.clear()
    assert report(copied_bytes=0) == plain
    assert met.count("shares") > 1  # texts go to their pairs in rounds
    assert held == [len(staged(spark, name)) for name in names]  # vectors kept for the search are gone with its end


def test_the_report_stores_texts_once(spark, monkeypatch):
    columns = []
    monkeypatch.setattr(registry, "stage", lambda df, name: columns.extend(df.columns) or stage(df, name))
    assert registry._near(spark, "/root/testdata/sf0.001").count()
    assert "document" in columns and "judul" not in columns


def test_first_visit_of_cells_is_gone_before_the_second(spark):
    raw = clustered(300, 16, 5, 1)
    rows, names = table(spark, raw), ("routed", "raised")
    held = [len(staged(spark, name)) for name in names]
    topk_cosine_cells(rows, rows.drop("exclude_id", "query_id"), 16, 5, exact=True, settings=Settings(tile_rows=60))
    assert [len(staged(spark, name)) - n for name, n in zip(names, held, strict=True)] == [1, 0]
