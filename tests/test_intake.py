import json

import pytest
from pyspark.sql import functions as F

from serupa import schemas
from serupa.operators import ingest as ing
from serupa.sources.exports import from_payloads, read_export, to_payloads


def raw(spark, *rows):
    return spark.createDataFrame([json.dumps({"judul": "Judul contoh", **r}) for r in rows], "string").select(
        F.from_json("value", schemas.RAW_DOC).alias("d")
    ).select("d.*")


def normalized(spark, row):
    return ing.normalize_ids(raw(spark, row)).first()


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ({"skripsi_id": 99}, ("skripsi_99", "skripsi", 99, None)),
        ({"laravel_id": "7"}, ("skripsi_7", "skripsi", 7, None)),
        ({"skripsi_id": 42, "document_type": "internship_report"}, ("internship_report_42", "internship_report", 42, None)),
        ({"skripsi_id": 1, "document_type": "", "type": "laporan"}, ("laporan_1", "laporan", 1, None)),
        ({"document_id": "skripsi_123"}, ("skripsi_123", "skripsi", 123, None)),
        ({"document_id": "internship_report_5"}, ("internship_report_5", "skripsi", 5, None)),
        ({"document_id": "a_b"}, ("a_b", "skripsi", None, None)),
        ({"document_id": 12}, ("12", "skripsi", None, None)),
        ({"document_id": "x", "skripsi_id": 0}, ("x", "skripsi", None, None)),
        ({}, (None, "skripsi", None, "id_missing")),
        ({"skripsi_id": 0}, (None, "skripsi", None, "id_missing")),
        ({"skripsi_id": "1a"}, ("skripsi_1a", "skripsi", None, "source_id_not_integer")),
    ],
)
def test_ids(spark, row, want):
    got = normalized(spark, row)
    assert (got.document_id, got.document_type, got.skripsi_id, got.id_error) == want


def test_document_bounds(spark):
    good = {"skripsi_id": 1}
    bad = [
        {"judul": "KP"}, {"judul": "x" * 501}, {"judul": None}, {"tahun": 1989}, {"tahun": 2101},
        {"bobot_judul": -0.5}, {"bobot_abstrak": -1.0}, {"bobot_kata_kunci": -1.0},
    ]
    fine = [{}, {"judul": "     "}, {"judul": "x" * 500}, {"tahun": 1990}, {"tahun": 2100}, {"bobot_judul": 0.0}]
    rows = raw(spark, *[{**good, **r} for r in bad + fine], {"judul": "Tanpa id"})
    valid, quarantine = ing.ingest(rows)
    assert valid.count() == len(fine)
    assert sorted(e for r in quarantine.collect() for e in r.errors) == sorted(
        ["judul_too_short", "judul_too_long", "judul_missing", "tahun_too_small", "tahun_too_large",
         "bobot_judul_negative", "bobot_abstrak_negative", "bobot_kata_kunci_negative", "id_missing"]
    )


def test_query_bounds(spark):
    rows = [
        (1, "Judul", None, None, None), (2, "Judul", 1, 0.0, "x"), (3, "Judul", 20, 1.0, None),
        (4, "Judul", 21, 0.5, None), (5, "Judul", 0, 0.5, None), (6, "Judul", 5, 1.1, None), (7, "KP", 5, 0.5, None),
        (8, "x" * 900, 5, 0.5, None), (9, None, 5, 0.5, None),
    ]
    valid, bad = ing.split_valid(ing.check_queries(spark.createDataFrame(rows, schemas.QUERY)))
    got = {r.query_id: (r.top_k, r.threshold, r.document_type) for r in valid.collect()}
    assert got[1] == (5, 0.5, None) and set(got) == {1, 2, 3, 8}
    assert {r.query_id: r.errors for r in bad.collect()} == {
        4: ["top_k_out_of_range"], 5: ["top_k_out_of_range"], 6: ["threshold_out_of_range"],
        7: ["judul_too_short"], 9: ["judul_missing"],
    }


def test_metadata(spark):
    rows = ing.normalize_ids(raw(spark, {"skripsi_id": 1}, {"skripsi_id": 2, "tahun": 2024, "program_studi": "TI"}))
    got = {r.skripsi_id: (r.tahun, r.program_studi) for r in ing.metadata(rows).collect()}
    assert got == {1: (0, "Tidak Diketahui"), 2: (2024, "TI")}
    assert ing.metadata(rows).columns == schemas.METADATA


def test_delete_key(values):
    got = values([("123",), ("internship_report_9",), ("12a",)], "k STRING", ing.delete_key(F.col("k")))
    assert got == ["skripsi_123", "internship_report_9", "12a"]


def test_read_export(spark, tmp_path):
    records = [{"skripsi_id": 1, "judul": "Satu dua", "tahun": 2020, "extra": 1}, {"skripsi_id": "2", "judul": "x"},
               {"skripsi_id": 0, "judul": "Nol nol"}, {"judul": "Tanpa"}]
    array, lines, other = tmp_path / "a.json", tmp_path / "l.json", tmp_path / "o.json"
    array.write_text("\n " + json.dumps(records, indent=1))
    lines.write_text("\n".join(map(json.dumps, records)))
    other.write_text(json.dumps({"data": records}))
    for path, as_lines in ((array, False), (lines, True)):
        df = read_export(spark, str(path), as_lines)
        kept = ing.export_documents(df)
        assert sorted(r.skripsi_id for r in kept.collect()) == ["1", "2"]
        counters = {r.counter: r.n for r in ing.export_counters(df).collect()}
        assert counters == {"received": 4, "skipped": 2, "sent": 1, "failed": 1}
    with pytest.raises(ValueError):
        read_export(spark, str(other))


def test_payload_forms(spark):
    docs = ing.with_columns(
        spark.createDataFrame([("skripsi_1", "é judul"), ("skripsi_2", None)], "document_id STRING, judul STRING"), schemas.DOC
    )
    sent = to_payloads(docs, F.lit(1), reset_index=True)
    assert json.loads(sent.first().payload)["reset_index"] is True
    back = from_payloads(sent)
    assert {(r.document_id, r.judul, r.reset_index) for r in back.collect()} == {
        ("skripsi_1", "é judul", True), ("skripsi_2", None, True)
    }
    forms = ['[{"document_id": "a", "judul": "x"}]', '{"data": [{"document_id": "b"}]}', ' [ ]', '{"reset_index": true}']
    got = from_payloads(spark.createDataFrame(forms, "string").toDF("payload")).collect()
    assert sorted((r.document_id, r.reset_index) for r in got) == [("a", False), ("b", False)]
