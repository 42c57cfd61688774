import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


@pytest.fixture
def pool(tmp_path):
    texts = {
        "a.json": json.dumps([{"id": 1, "t": "x"}, {"id": 2, "t": "vendor/y", "more": 3}, {"id": "no number"}]),
        "b.json": json.dumps({"id": 4, "t": "é"}), "c.json": '[{"id": 5}, 7, "text", null, [1]]', "d.json": '[{"id": 6},', "e.json": "[]", "f.json": "12",
        "sub/g.json": '[\n  {"id": 8,\n   "t": null}\n]', "h.txt": '[{"id": 9}]', "i.json": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_arrays(spark, pool):
    rows = files.json_array_rows(spark, pool, "id long, t string").cache()
    got = {(r.source_file.rsplit("/", 1)[1], r.position, None if r.record is None else tuple(r.record), r.error) for r in rows.collect()}
    assert got == {
        ("a.json", 0, (1, "x"), None), ("a.json", 1, (2, "vendor/y"), None), ("a.json", 2, (None, None), None), ("b.json", 0, (4, "é"), None),
        ("c.json", 0, (5, None), None), ("c.json", 1, None, "not an object"), ("c.json", 2, None, "not an object"), ("c.json", 3, None, "not an object"), ("c.json", 4, None, "not an object"),
        ("d.json", None, None, "unreadable"), ("f.json", None, None, "unreadable"), ("g.json", 0, (8, None), None),
    }
    good = files.good_records(rows, F.col("t").startswith("vendor/"))
    assert good.columns == ["source_file", "position", "id", "t"]
    assert sorted(r.id for r in good.where("id IS NOT NULL").collect()) == [1, 4, 5, 8]


def test_configuration(spark, tmp_path):
    (tmp_path / "1.yaml").write_text("eval:\n  overall: 0.5\n  dims: {sql: 0.7, i18n: null}\n  names: [a, b]\nminimum:\n  x:y: 3\n")
    (tmp_path / "2.yaml").write_text("eval:\n  overall: 0.6\n")
    (tmp_path / "3.yaml").write_text("eval: [unclosed\n")
    (tmp_path / "4.json").write_text('{"flag": true, "text": "true", "empty": {}}')
    (tmp_path / "5.yaml").write_text("")
    rows = files.config_rows(spark, str(tmp_path)).cache()
    got = {(r.source_file[-6:], r.key, r.value, r.error) for r in rows.collect()}
    assert got == {
        ("1.yaml", "eval.overall", "0.5", None), ("1.yaml", "eval.dims.sql", "0.7", None), ("1.yaml", "eval.dims.i18n", None, None), ("1.yaml", "eval.names.0", "a", None), ("1.yaml", "eval.names.1", "b", None),
        ("1.yaml", "minimum.x:y", "3", None), ("2.yaml", "eval.overall", "0.6", None), ("3.yaml", None, None, "unreadable"), ("4.json", "flag", "true", None), ("4.json", "text", "true", None), ("4.json", "empty", "{}", None),
    }
    values = files.config_values(rows, {"overall": 0.1, "dims": {"sql": 0.2, "perf": 0.3}, "absent": 4, "nested": {"a": 1, "b": [2]}}, "eval")
    assert {(r.key, r.value) for r in values.collect()} == {("overall", "0.6"), ("dims.sql", "0.7"), ("dims.i18n", None), ("absent", "4"), ("nested.a", "1"), ("nested.b.0", "2")}
