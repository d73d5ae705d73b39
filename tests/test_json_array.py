"""JSON arrays read by byte ranges."""

import json
import random

import pytest

from serupa.sources import json_array
from serupa.sources.exports import read_export


@pytest.fixture
def split(spark, monkeypatch):
    """Ranges of so many bytes for the files, not for staged tables."""
    limit, usual, pieces = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"), json_array._pieces

    def set_bytes(n):
        def ranged(*args):
            spark.conf.set(limit, str(n))
            try:
                return pieces(*args)
            finally:
                spark.conf.set(limit, usual)

        monkeypatch.setattr(json_array, "_pieces", ranged)

    return set_bytes


ODD = [
    {"a": "plain"}, {}, {"a": '}{"}],[{', "b": {"c": {"d": "}"}, "e": [{}, {"f": "\\"}]}}, {"a": "\\\\\"}", "b": {}}, {"a": "é漢\n\t{"}, {"[": "]", "{": "}"},
    {"a": '"' * 9, "b": [[], {}, [{"x": None}]]}, {"a": "\\"}, {"long": "x},{" * 20},
]


def written(tmp_path, text, name="a.json"):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


def objects(spark, path):
    rows = json_array.json_objects(spark, path).collect()
    return [json.loads(r.record) for r in sorted(rows, key=lambda r: (r.file, r.start, r.row))], rows


def test_every_boundary(spark, split, tmp_path):
    text = json.dumps([{"a": '}"{\\', "b": {"c": "}"}}, {}, {"é": ["{"]}])
    path = written(tmp_path, text)
    for size in (1, 2, 3, 7, 20):
        split(size)
        found, rows = objects(spark, path)
        assert found == json.loads(text) and len(rows) == 3, size


@pytest.mark.parametrize("indent", [None, 2])
def test_odd_objects_in_several_files(spark, split, tmp_path, indent):
    r = random.Random(8)
    lists = [r.choices(ODD, k=60), ODD, [], ODD[:1]]
    for i, part in enumerate(lists):
        written(tmp_path, " \n" * i + json.dumps(part, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * i, f"{i}.json")
    for size in (101, 1 << 20):
        split(size)
        found, rows = objects(spark, str(tmp_path))
        assert found == [x for part in lists for x in part]
        assert len({(r.file, r.start, r.row) for r in rows}) == len(rows)


def test_a_file_is_read_by_several_tasks(spark, split, tmp_path):
    path = written(tmp_path, json.dumps([{"n": i, "s": "x" * 50} for i in range(500)]))
    split(4096)
    assert json_array._pieces(spark, path).select("start").distinct().count() > 5
    assert json_array.json_objects(spark, path).count() == 500


@pytest.mark.parametrize("text", ['{"a": 1}', '{"a": 1}\n{"a": 2}', "[1, 2]", '[{"a": 1}, 2, {"a": 3}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}', '[{"a": {"b": 1}]', '[{"a": 1}]]', '["}"]', "null", "[", '{"a": [{"b": 1}]}'])
def test_anything_else_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception, match="JSON array"):
        json_array.json_objects(spark, written(tmp_path, text)).collect()
    if not text.startswith("["):
        with pytest.raises(ValueError, match="JSON array"):
            read_export(spark, str(tmp_path), whole_files=True)


def test_rows_as_the_whole_file_reader_gives_them(spark, split, tmp_path):
    rows = [{"skripsi_id": i, "judul": f'Judul "{i}" }}', "abstrak": None if i % 3 else "a\\b {", "tahun": 2000 + i} for i in range(300)]
    path = written(tmp_path, json.dumps(rows, indent=1))
    split(1000)
    plain = read_export(spark, path, whole_files=True)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(read_export(spark, path)) == key(plain) and plain.count() == 300


def test_written_arrays_are_read_back(spark, tmp_path):
    df = spark.range(1000, numPartitions=3).selectExpr("id", "concat('}\"', id) AS s", "struct(id AS x) AS nested")
    json_array.write_json_array(df, str(tmp_path / "out"))
    json_array.write_json_array(df.where("id < 0"), str(tmp_path / "none"))
    for f in (tmp_path / "out").glob("*.txt"):
        assert isinstance(json.loads(f.read_text()), list)
    back = json_array.read_json_array(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert json_array.read_json_array(spark, str(tmp_path / "none"), df.schema).count() == 0
