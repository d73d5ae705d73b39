import csv
import glob
import json

from serupa import schemas
from serupa.operators import evaluate
from serupa.operators.encode import HashEncoder
from serupa.plans.compare import score_pairs
from serupa.sources.reports import builtin_pairs, read_pairs, write_metrics

SCHEMA = "no BIGINT, judul_a STRING, judul_b STRING, label INT, score DOUBLE, semantic_score DOUBLE, lexical_score DOUBLE, level STRING"


def plain_metrics(rows, t):
    tp = sum(s >= t and y == 1 for s, y in rows)
    fp = sum(s >= t and y == 0 for s, y in rows)
    fn = sum(s < t and y == 1 for s, y in rows)
    tn = sum(s < t and y == 0 for s, y in rows)
    p = tp / (tp + fp) if tp + fp else 0.0
    r = tp / (tp + fn) if tp + fn else 0.0
    f = 2 * p * r / (p + r) if p + r else 0.0
    a = (tp + tn) / len(rows) if rows else 0.0
    return (t, tp, fp, fn, tn, round(p, 4), round(r, 4), round(f, 4), round(a, 4))


def test_sweep(spark):
    rows = [(0.4, 1), (0.65, 1), (0.65, 0), (0.9, 1), (0.3, 0), (0.72, 0), (0.95, 1), (0.1, 1)]
    df = spark.createDataFrame(rows, "score DOUBLE, label INT")
    swept = evaluate.metrics(df)
    got = sorted(tuple(r) for r in swept.collect())
    assert got == [plain_metrics(rows, t) for t in evaluate.SWEEP] and len(got) == 12
    best = max(got, key=lambda m: m[7])
    assert tuple(evaluate.best_threshold(swept).first()) == best
    assert tuple(evaluate.target_metrics(df).first()) == plain_metrics(rows, 0.65)
    assert swept.columns == schemas.METRIC_COLUMNS


def test_sweep_without_pairs(spark):
    got = evaluate.metrics(spark.createDataFrame([], "score DOUBLE, label INT")).collect()
    assert sorted(tuple(r) for r in got) == [(t, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0) for t in evaluate.SWEEP]


def test_failed_scoring_counts_as_zero(spark):
    df = spark.createDataFrame([(1, "a", "b", 1, None, None, None, None), (2, "a", "b", 1, 0.9, 0.9, 0.9, "TINGGI")], SCHEMA)
    got = {r.no: (r.score, r.level, r.predicted, r.status) for r in evaluate.predictions(df).collect()}
    assert got == {1: (0.0, "ERROR", 0, "SALAH"), 2: (0.9, "TINGGI", 1, "OK")}


def test_reports(spark, tmp_path):
    pairs = builtin_pairs(spark)
    assert pairs.count() == 22 and pairs.where("label = 1").count() == 11
    predictions = evaluate.predictions(score_pairs(pairs, HashEncoder())).cache()
    swept = evaluate.metrics(predictions).cache()
    best, target = evaluate.best_threshold(swept), evaluate.target_metrics(predictions)
    out = str(tmp_path / "report")
    write_metrics(out, 22, target, best, swept, predictions, "hash-256", 0.65)

    def table(name):
        lines = [row for part in sorted(glob.glob(f"{out}/{name}/part*")) for row in csv.reader(open(part, encoding="utf-8"))]
        return lines[0], [row for row in lines if row != lines[0]]

    header, body = table("threshold_sweep")
    assert header == schemas.METRIC_COLUMNS and [float(r[0]) for r in body] == list(evaluate.SWEEP)
    header, body = table("predictions")
    assert header == schemas.PREDICTION_COLUMNS and [int(r[0]) for r in body] == list(range(1, 23))
    summary = json.loads(open(glob.glob(f"{out}/summary/part*")[0], encoding="utf-8").read())
    assert summary["meta"]["total_pairs"] == 22 and len(summary["metrics_by_threshold"]) == 12
    assert summary["meta"]["best_threshold"] == summary["best_threshold_metrics"]["threshold"]
    assert summary["target_threshold_metrics"]["threshold"] == 0.65


def test_read_pairs(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps([{"judul_a": "a", "judul_b": "b", "label": 1}, {"judul_a": "c", "judul_b": "d", "label": 0}]))
    assert [tuple(r) for r in read_pairs(spark, str(path)).collect()] == [(1, "a", "b", 1), (2, "c", "d", 0)]
    lines = tmp_path / "pairs.jsonl"
    lines.write_text(json.dumps({"no": 7, "judul_a": "a", "judul_b": "b", "label": 1}))
    assert [tuple(r) for r in read_pairs(spark, str(lines), lines=True).collect()] == [(7, "a", "b", 1)]
