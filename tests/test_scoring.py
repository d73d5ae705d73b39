import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serupa.functions import scoring, vectors
from serupa.functions.rounding import percent_text, round4
from serupa.functions.weights import resolve_weights
from serupa.plans.check import parse_hit_id, semantic_floor


def test_levels(values):
    want = {
        "SANGAT TINGGI": [1.0, 0.90, 0.85],
        "TINGGI": [0.849, 0.77, 0.70],
        "SEDANG": [0.699, 0.60, 0.50],
        "RENDAH": [0.499, 0.30, 0.0],
    }
    rows = [(s,) for scores in want.values() for s in scores]
    assert values(rows, "s DOUBLE", scoring.level(F.col("s"))) == [n for n, scores in want.items() for _ in scores]


def test_percent_golden(values):
    cases = [(0.0, "0.0%"), (-0.0, "-0.0%"), (-0.0505, f"{-0.0505 * 100:.1f}%")]
    cases += {1.0: "100.0%", 0.5: "50.0%", 0.921: "92.1%", 0.8734: "87.3%", 0.750: "75.0%",
             0.1245: "12.4%", 0.0025: "0.2%", 0.8505: "85.0%"}.items()
    got = values([(score,) for score, _ in cases], "s DOUBLE", percent_text(F.col("s")))
    assert got == [text for _, text in cases]


def test_rounding_matches_python(values):
    rng = random.Random(5)
    numbers = [0.7 * round(rng.random(), 4) + 0.3 * rng.randint(0, 9) / rng.randint(9, 20) for _ in range(8000)]
    numbers += [(2 * n + 1) / 20000 for n in range(0, 10000, 7)] + [(2 * n + 1) / 20000 for n in range(60)]
    numbers += [-x for x in numbers[:500]]

    @settings(max_examples=500, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.floats(0, 1))
    def gather(x):
        numbers.append(x)

    gather()
    got = values([(x,) for x in numbers], "x DOUBLE", round4(F.col("x")), percent_text(F.col("x")))
    wrong = [
        (x, r, p) for x, (r, p) in zip(numbers, got, strict=True) if r != round(x, 4) or p != f"{x * 100:.1f}%"
    ]
    assert not wrong


JACCARD = [
    ("a b", "a b", 1.0), ("a b", "c d", 0.0), ("a b", "b c", 1 / 3), ("", "kucing", 0.0), ("", "", 0.0),
    ("Sistem", "sistem", 0.0), ("a a", "a b", 0.5), ("a b", "b a", 1.0),
    ("klasifikasi penyakit diabetes knn", "klasifikasi diabetes menggunakan knn", 0.6),
]


def test_jaccard(values):
    schema = "a STRING, b STRING"
    assert values([(a, b) for a, b, _ in JACCARD], schema, scoring.jaccard(F.col("a"), F.col("b"))) == [
        x for _, _, x in JACCARD
    ]
    swapped = values([(b, a) for a, b, _ in JACCARD], schema, scoring.jaccard(F.col("a"), F.col("b")))
    assert swapped == [x for _, _, x in JACCARD]


def test_weights(values):
    cases = [
        ((None, None, None), (0.7, 0.2, 0.1)),
        ((2.0, 1.0, 1.0), (0.5, 0.25, 0.25)),
        ((-1.0, 1.0, 0.0), (0.0, 1.0, 0.0)),
        ((0.0, 0.0, 0.0), (0.7, 0.2, 0.1)),
        ((1.0, 0.0, 0.0), (1.0, 0.0, 0.0)),
    ]
    got = values([c for c, _ in cases], "j DOUBLE, a DOUBLE, k DOUBLE", resolve_weights(F.col("j"), F.col("a"), F.col("k")))
    for row, (_, want) in zip(got, cases, strict=True):
        assert tuple(row) == pytest.approx(want) and sum(row) == pytest.approx(1.0)


def test_weights_without_usable_defaults(values):
    zero = type(scoring.DEFAULTS)(weight_title=0.0, weight_abstract=-1.0, weight_keywords=0.0)
    got = values([(None, None, None)], "j DOUBLE, a DOUBLE, k DOUBLE", resolve_weights(F.col("j"), F.col("a"), F.col("k"), zero))
    assert tuple(got[0]) == (1.0, 0.0, 0.0)


def test_vectors(values):
    schema = "a ARRAY<FLOAT>, b ARRAY<FLOAT>"
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    a, b = F.col("a"), F.col("b")
    got = values(rows, schema, vectors.dot(a, b), vectors.cosine(a, b), vectors.l2_normalize(a))
    assert got[0] == (24.0, 0.96, [0.6, 0.8])
    assert got[1] == (0.0, 0.0, [0.0, 0.0])


def test_weighted_embedding(values):
    schema = "a ARRAY<FLOAT>, b ARRAY<FLOAT>, c ARRAY<FLOAT>"
    w = [F.lit(0.6), F.lit(0.8), F.lit(0.0)]
    parts = [F.col(x) for x in "abc"]
    got = values([([1.0, 0.0], [0.0, 1.0], None), ([1.0, 0.0], None, None)], schema, vectors.weighted_embedding(parts, w))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([1.0, 0.0])


def test_hit_ids(values):
    rows = [("skripsi_42", "skripsi"), ("internship_report_7", "skripsi"), ("3", "lain"), ("3x", None), ("x_y", "z"),
            ("skripsi_ -5", "z")]
    number, kind = parse_hit_id(F.col("i"), F.col("t"))
    assert values(rows, "i STRING, t STRING", number, kind) == [
        (42, "skripsi"), (7, "internship_report"), (3, "lain"), (0, "skripsi"), (0, "unknown"), (-5, "skripsi")
    ]


def test_semantic_floor_never_cuts_a_hit():
    for threshold in (0.0, 0.3, 0.5, 0.85, 1.0):
        floor = semantic_floor(threshold)
        for i in range(-10000, 10001, 3):
            cosine = i / 10000 + 0.00003
            if round(0.7 * round(cosine, 4) + 0.3, 4) >= threshold:
                assert cosine >= floor
    assert math.isfinite(semantic_floor(0.5))
