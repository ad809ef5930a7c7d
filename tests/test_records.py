"""Open records: aliases found in any shape, fields carried through."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.sources import records as R

BOX = [1, 2, 3.5, 4]
CASES = [
    ({"regions": [{"bbox": BOX, "type": "printed", "text": "a", "more": {"deep": [1]}}]}, "regions", [(BOX, "printed", "a")]),
    ({"annotations": [{"box": BOX, "label": "", "class": "x", "transcription": "b"}, {"no": 1}, "odd"]}, "annotations", [(BOX, "x", "b")]),
    ({"regions": [{"bbox": ["1", "2", "3", "4"]}], "objects": [{"bounds": BOX, "category": 7}]}, "objects", [(BOX, "7", "")]),
    ({"regions": [], "z": [{"bounding_box": BOX, "value": "v"}], "a": [{"bbox": BOX, "value": "w"}]}, "z", [(BOX, None, "v")]),
    ({"first": [1, 2], "boxes": [BOX, [5, 6, 7, 8]], "labels": ["p"], "classes": ["p", None], "values": ["s", 4]}, "boxes", [(BOX, "p", "s"), ([5, 6, 7, 8], None, "4")]),
    ({"regions": [{"bbox": BOX, "type": 0, "label": "0", "text": False, "value": "false"}]}, "regions", [(BOX, "0", "false")]),
    ({"bboxes": [BOX]}, "bboxes", [(BOX, None, "")]),
    ({"bboxes": [[1, 2, 3]], "text": "no list"}, None, None),
    ({"regions": {"bbox": BOX}, "bbox": BOX}, None, None),
    ({}, None, None),
    ({"regions": [{"bbox": [1, 2, 3, "4"]}, {"bbox": None}], "mixed": [BOX, "x"]}, None, None),
]


def _written(path, values):
    path.mkdir()
    (path / "a.jsonl").write_text("".join(json.dumps(v, ensure_ascii=False) + "\n" for v in values), encoding="utf-8")
    return str(path)


def test_aliases(spark, tmp_path):
    rows = R.read_records(spark, _written(tmp_path / "r", [c[0] for c in CASES]))
    got = rows.select("_row_index", R.regions_in(F.col("record"), F.col("names")).alias("f")).orderBy("_row_index").collect()
    for (record, key, regions), r in zip(CASES, got, strict=True):
        assert (r.f and r.f.key) == key, record
        assert (r.f and [(x.bbox, x.type, x.text) for x in r.f.regions]) == regions, record


def test_every_field_is_carried(spark, tmp_path):
    """Fields of mixed kinds, nested and unknown ones, come back as they were; what was worked out stands beside them."""
    values = [
        {"crop_id": "a", "reference_text": "слон", "predicted_text": "слін", "extra": {"n": [1, "two", None, {"x": 1.5}]}, "odd": 3},
        {"crop_id": "b", "text": "same", "predicted_text": "same", "odd": "three", "cer": 0.75, "reference_length": 99, "empty": None},
        {"crop_id": "c", "predicted_text": "", "odd": [True, {}], "token_length": 12},
    ]
    rows = R.enriched_records(R.read_records(spark, _written(tmp_path / "in", values)), max_tokens=10)
    R.write_records(rows, str(tmp_path / "out"))
    back = {x["crop_id"]: x for f in (tmp_path / "out").glob("part-*") for x in map(json.loads, f.read_text(encoding="utf-8").splitlines())}
    for v in values:
        assert {k: back[v["crop_id"]][k] for k in v} == v
        assert list(back[v["crop_id"]]) == sorted(back[v["crop_id"]])
    a, b, c = back["a"], back["b"], back["c"]
    assert (a["edit_distance"], a["cer"], a["edit_cyrillic_substitutions"], a["error_buckets"]) == (1, 0.25, 1, ["cyrillic_character_confusion"])
    assert (b["cer"], b["reference_length"], b["reference_text"], b["error_buckets"]) == (0.75, 99, "same", ["other_ocr_error"])
    assert c["error_buckets"] == ["truncation_failure", "empty_prediction"] and c["cer"] == 0.0


def test_schema_of_all_records(spark, tmp_path):
    rows = R.read_records(spark, _written(tmp_path / "s", [{"a": 1}, {"a": 2.5, "b": {"c": "x"}}, {"b": {"d": [1]}}]))
    schema = R.field_schema(rows).first().schema
    assert "a" in schema and "c: STRING" in schema and "d: ARRAY<BIGINT>" in schema


@pytest.mark.parametrize("line", ["", "{broken"])
def test_bad_records_raise(spark, tmp_path, line):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n' + line + '\n{"a": 2}\n')
    with pytest.raises(Exception):  # noqa: B017
        R.read_records(spark, str(tmp_path)).collect()
    assert [r._row_index for r in R.read_records(spark, str(tmp_path), limit=1).collect()] == [0]
