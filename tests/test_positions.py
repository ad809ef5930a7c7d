"""Places of rows in their files, open records, sinks that are written in one pass and files with a commit."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.plans import builders as B
from pagemill.operators import selection as L
from pagemill.sources import files, positions, sinks
from pagemill.sources import readers as S


@pytest.fixture
def pages(spark, tmp_path):
    """Three files whose names are out of the order in which they were written, of several row groups."""
    rows = {"b": range(700), "a": range(10_000, 10_300), "c": range(20_000, 20_050)}
    for name, ids in rows.items():
        part = spark.createDataFrame([(f"p{k}", "x" * 50) for k in ids], "image_id string, filler string").coalesce(1)
        part.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "train" / f"{name}.parquet"))
    return str(tmp_path), [f"p{k}" for name in sorted(rows) for k in rows[name]]


def _in_folder(spark, path):
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def test_parquet_places(spark, pages):
    path, ids = pages
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        df = positions.parquet_in_order(_in_folder(spark, path))
        assert [(r.image_id, r._row_index) for r in df.orderBy("_row_index").collect()] == list(zip(ids, range(len(ids))))
        for n in (0, 1, 299, 301, 5000):
            first = positions.parquet_in_order(_in_folder(spark, path), limit=n)
            assert sorted(r._row_index for r in first.collect()) == list(range(min(n, len(ids)))) and {r.image_id for r in first.collect()} == set(ids[:n])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_are_not_shuffled(spark, pages):
    plan = positions.parquet_in_order(_in_folder(spark, pages[0]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"SortMergeJoin|ShuffledHashJoin", plan)
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert sum("filler" in line.split("ReadSchema")[1] for line in scans) == 1  # the other scan counts


def test_places_that_rows_bring_along(spark, tmp_path):
    spark.createDataFrame([("a", None), ("b", 77), ("c", None)], "image_id string, _row_index long").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = S.read_pages(spark, str(tmp_path), "t").orderBy("image_id").collect()
    assert [r._row_index for r in got] == [0, 77, 2]
    assert [r.image_id for r in S.read_pages(spark, str(tmp_path), "t", limit=2).orderBy("image_id").collect()] == ["a", "b"]


def test_lines_in_order(spark, tmp_path):
    """Files of different sizes, blocks that cut lines, repeated lines, a last line without an end, an empty file."""
    texts = {"2.jsonl": [json.dumps({"crop_id": f"two{k}", "text": "é" * (k % 90)}, ensure_ascii=False) for k in range(400)], "1.jsonl": ['{"crop_id": "one"}'] * 30, "3.jsonl": ['{"crop_id": "three"}'], "4.jsonl": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    want = [json.loads(x)["crop_id"] for name in sorted(texts) for x in texts[name]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = S.read_manifest(spark, str(tmp_path), index="_row_index").select("_row_index", "crop_id").collect()
        assert sorted(tuple(r) for r in rows) == list(enumerate(want))
        for n in (0, 7, 31, 100):
            got = S.read_manifest(spark, str(tmp_path), limit=n)
            assert "_line" not in got.columns and sorted(r.crop_id for r in got.collect()) == sorted(want[:n])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("bad", ["", "  ", "{broken"])
def test_bad_lines_raise(spark, tmp_path, bad):
    (tmp_path / "m.jsonl").write_text('{"crop_id": "a"}\n' + bad + '\n{"crop_id": "b"}\n')
    assert S.read_manifest(spark, str(tmp_path), limit=1).count() == 1  # lines behind the limit are not looked at
    with pytest.raises(Exception):  # noqa: B017
        S.read_manifest(spark, str(tmp_path)).collect()


def test_a_page_without_name_or_place_raises(spark):
    region = "array<struct<bbox: array<double>, type: string, text: string, language: string, legibility: string>>"
    pages = spark.createDataFrame([(None, 100, 100, None, [])], f"file_name string, image_width int, image_height int, source string, regions {region}")
    pages = pages.withColumns({"image_id": F.lit(None).cast("string"), "id": F.lit(None).cast("string")})
    with pytest.raises(Exception, match="without an id"):
        B.export_decisions(pages).collect()
    named = B.export_decisions(pages.withColumn("_row_index", F.lit(3).cast("long")))
    assert [r.image_id for r in named.collect()] == ["stream_000003.jpg"]
    assert B.export_counts(named).count() == 0  # a page without regions is no skipped region


def test_a_split_is_several_files_in_order(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("train").alias("split"), F.format_string("im%04d", F.col("id") % 400).alias("image_id"), F.expr("cast(id div 400 as int)").alias("region_index"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        sinks.write_splits(rows, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "m" / "split=train").glob("part-*.json"))
    found = [(r["image_id"], r["region_index"]) for f in files for r in map(json.loads, f.read_text().splitlines())]
    assert len(files) > 1 and found == sorted(found) and len(found) == 4000


# files with a commit -------------------------------------------------------------------------------------------------
def _files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_files_are_committed(spark, tmp_path):
    rows = [(f"crops/{k % 3}/f{k}.bin", bytes([k]) * k) for k in range(40)] + [("crops/none", None), (None, b"x")]
    df = spark.createDataFrame(rows, "name string, data binary").repartition(7)
    assert files.write_files(df, str(tmp_path / "out"), "name", "data") == {"files": 40, "bytes": sum(range(40))}
    found = _files(tmp_path / "out")
    done = json.loads(found.pop(files.DONE))
    assert found == {n: d for n, d in rows[:40]} and done["files"] == 40


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    """One task fails after others have ended: neither whole nor half files stay, and what was there before does."""
    before = tmp_path / "out" / "old.bin"
    before.parent.mkdir()
    before.write_bytes(b"old")
    slow = F.udf(lambda k: (__import__("time").sleep(3), 1 / 0)[1] if k == 39 else bytes([k]), "binary")
    df = spark.range(0, 40, 1, 8).select(F.format_string("a/f%d", "id").alias("path"), slow("id").alias("content"))
    with pytest.raises(Exception):  # noqa: B017
        files.write_files(df, str(tmp_path / "out"))
    assert _files(tmp_path / "out") == {"old.bin": b"old"}


def test_a_path_outside_raises(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        files.write_files(spark.createDataFrame([("../x", b"1")], "path string, content binary"), str(tmp_path / "out"))


@pytest.mark.parametrize("n", [None, 10])
def test_seeded_order(spark, n):
    ids = [f"c{k:03d}" for k in range(200)]
    want = sorted(ids)
    random.Random(42).shuffle(want)
    df = spark.createDataFrame([(i, "x") for i in reversed(ids)], "crop_id string, text string").repartition(6)
    got = L.in_seeded_order(df, "crop_id", 42, n).orderBy("shuffled").collect()
    assert [r.crop_id for r in got] == want[:n] and got[0].text == "x"
    with pytest.raises(ValueError, match="200 rows"):
        L.in_seeded_order(df, "crop_id", 42, most=100)
