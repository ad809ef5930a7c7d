import json
import os
import random
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.operators import recognizers as R
from pagemill.sources import byte_ranges as Y
from pagemill.sources import data_sets as D
from pagemill.streaming import last_rows as L
from pagemill.streaming.ingest import run_available


# data sets -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def data_set(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("set"))
    spark.sql("SELECT id, CAST(id AS INT) AS year, 'a' AS split, array(named_struct('t', id, 'x', 'p')) AS regions, named_struct('k', 1) AS note FROM range(3)").write.parquet(f"{root}/gt/train")
    spark.sql("SELECT id, id / 2 AS year, array(named_struct('x', 'q', 'w', true)) AS regions, 'n' AS note, 7 AS more FROM range(4)").write.parquet(f"{root}/gt/silver")
    spark.range(5).write.parquet(f"{root}/test/test")
    return root


def test_splits_that_differ_are_joined(spark, data_set):
    df = D.read_data_set(spark, data_set)
    assert {(f.name, f.dataType.simpleString()) for f in df.schema if f.name in ("year", "regions", "note")} == {("year", "double"), ("regions", "array<struct<x:string,w:boolean,t:bigint>>"), ("note", "string")}
    rows = {(r.split, r.id): r for r in df.collect()}
    assert len(rows) == 12 and {(r.config, r.split, r.revision) for r in rows.values()} == {("gt", "train", None), ("gt", "silver", None), ("test", "test", None)}
    assert rows["train", 2].regions[0].asDict() == {"x": "p", "w": None, "t": 2} and json.loads(rows["train", 2].note) == {"k": 1}
    assert rows["silver", 3].year == 1.5 and rows["silver", 3].note == "n" and rows["test", 4].regions is None and rows["test", 4].more is None


def test_filters_leave_scans_out(spark, data_set):
    df = D.read_data_set(spark, data_set).where("split = 'silver' AND year > 0.5").select("id", "split")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "gt/silver" in plan and "regions" not in plan and "GreaterThan(year,0.5)" in plan
    assert sorted(r.id for r in df.collect()) == [2, 3]
    few = D.read_data_set(spark, data_set, config="gt", limit=2)
    assert few.count() == 2 and "LocalLimit" in few._jdf.queryExecution().optimizedPlan().toString()


def test_revisions_and_streams(spark, tmp_path):
    for r in ("r1", "r2"):
        spark.range(len(r)).write.parquet(f"{tmp_path}/snapshots/{r}/main/train")
    assert {(f[0], f[1], f[2]) for f in D.split_folders(spark, str(tmp_path))} == {("r1", "main", "train"), ("r2", "main", "train")}
    assert {r.revision for r in D.read_data_set(spark, str(tmp_path), revision="r2").collect()} == {"r2"}
    with pytest.raises(ValueError, match="several"):
        D.read_data_set(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no Parquet"):
        D.read_data_set(spark, str(tmp_path), split="none")
    run_available(D.read_data_set(spark, str(tmp_path), revision="r1", streaming=True), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1]


# byte ranges ---------------------------------------------------------------------------------------------------------
def whole_file(data):
    try:
        data.decode()
        error = None
    except UnicodeDecodeError as e:
        error = (e.start, e.end, data[e.start : e.end].hex(), e.reason)
    text = data.decode(errors="replace")
    return len(data), error is None, error, text.count("�"), len(text)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 64])
def test_ranges_give_the_whole_files_answer(spark, tmp_path, width):
    draw = random.Random(width)
    parts = [b"a", "ї".encode(), "€".encode(), "😀".encode(), "�".encode(), b"\x80", b"\xbf", b"\xc0", b"\xe0\x80", b"\xe2\x82", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xf4\x90", b"\xff"]
    valid = parts[:5]
    files = {"empty": b"", **{f"v{k}": b"".join(draw.choices(valid, k=k)) for k in range(1, 12)}, **{f"x{k}": b"".join(draw.choices(parts, k=k)) for k in range(1, 30)}}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {Path(r.path).name: (r.n_bytes, r.valid, r.error and tuple(r.error), r.n_replacement, r.n_chars) for r in Y.utf8_by_ranges(spark, str(tmp_path), width).collect()}
    assert got == {name: whole_file(data) for name, data in files.items()}


def test_small_files_share_a_task(tmp_path):
    for k in range(20):
        (tmp_path / f"f{k}").write_bytes(b"x" * 10)
    (tmp_path / "large").write_bytes(b"x" * 250)
    pieces = [p.pieces for p in Y.RangeReader({"path": str(tmp_path), "width": "100", "pattern": "*"}).partitions()]
    assert len(pieces) == 5 and max(sum(p[3] - p[2] for p in ps) for ps in pieces) <= 100


# recognisers ---------------------------------------------------------------------------------------------------------
def test_batches_are_bounded():
    sizes = [5, 0, 100, 7, 7, 3, 900, 5]
    batches = R.padded_batches(sizes, 20)
    assert sorted(k for b in batches for k in b) == list(range(8))
    assert all(len(b) == 1 or len(b) * max(sizes[k] for k in b) <= 20 for b in batches)
    assert R.padded_batches([], 20) == []


@pytest.mark.parametrize(("budget", "chunk"), [(1, 10_000), (40, 7), (1 << 20, 10_000)])
def test_a_model_is_loaded_once_a_task(spark, tmp_path, budget, chunk):
    notes = str(tmp_path)

    def load():
        Path(notes, f"load-{uuid.uuid4().hex}").touch()

        def model(images, texts):
            longest = max(map(len, images))
            if len(images) > 1 and len(images) * longest > budget:
                raise ValueError("beyond the budget")
            return [(f"{t}:{len(i)}", len(i) / 2) for i, t in zip(images, texts, strict=True)]

        return model

    R.register("counting", R.in_batches(load, budget))
    rows = [(k, ["printed", "image", None][k % 3], bytes(k % 11) if k % 5 else None, f"t{k}" if k % 7 else None) for k in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        got = R.recognize(spark.createDataFrame(rows, "id int, region_type string, image binary, text string").repartition(3), "counting").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        del R._known["counting"]
    assert {r.id: (r.predicted_text, r.score) for r in got} == {k: ("", None) if kind == "image" or i is None else (f"{t}:{len(i)}", len(i) / 2) for k, kind, i, t in rows}
    assert len(list(tmp_path.iterdir())) <= 3


def test_a_model_that_loses_results_raises(spark):
    R.register("short", R.in_batches(lambda: lambda images, texts: [("", None)][: len(images) - 1]))
    try:
        with pytest.raises(Exception, match="results for"):
            R.recognize(spark.createDataFrame([("printed", b"x", "t")], "region_type string, image binary, text string"), "short").collect()
    finally:
        del R._known["short"]


# last rows over batches ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2])
def test_any_cutting_gives_the_batch_answer(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [{"crop_id": draw.choice(["a", "b", "c", "d", None]), "at": draw.choice([None, *range(8)]), "edit_distance": draw.randrange(5), "reference_length": draw.randrange(1, 9), "text_length_bucket": draw.choice(["s", "l", None])} for _ in range(60)]
    schema = "crop_id string, at long, edit_distance long, reference_length long, text_length_bucket string"
    (tmp_path / "in").mkdir()
    cuts = sorted(draw.sample(range(1, 60), 3))
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
        (tmp_path / f"in/{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[i:j]))
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        if k != 1:  # two files at once in one of the runs
            run_available(L.last_row_changes(stream, "at"), f"{tmp_path}/out", f"{tmp_path}/cp")
    last = {}
    for r in rows:
        if r["crop_id"] and r["at"] is not None:
            mine = (r["at"], r["edit_distance"], r["reference_length"], r["text_length_bucket"] or "")
            last[r["crop_id"]] = max(last.get(r["crop_id"], mine), mine)
    want = {b: (len(g), sum(x[1] for x in g), sum(x[2] for x in g)) for b in {x[3] for x in last.values()} for g in [[x for x in last.values() if x[3] == b]]}
    changes = spark.read.parquet(f"{tmp_path}/out")
    got = {r.text_length_bucket: (r.n, r.edit_distance, r.reference_length) for r in L.current_rates(changes, "text_length_bucket").collect()}
    assert got == want
    assert L.current_rates(changes).select(F.round("cer", 9)).first()[0] == round(sum(x[1] for x in last.values()) / sum(x[2] for x in last.values()), 9)


def test_the_processor_travels_by_value(tmp_path):
    """A worker that cannot import the package loads it all the same."""
    (tmp_path / "p").write_bytes(cloudpickle.dumps(L.LastRow()))
    code = "import sys; from pyspark import cloudpickle; p = cloudpickle.load(open(sys.argv[1], 'rb')); assert 'pagemill' not in sys.modules; print(type(p).__name__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "p")], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "LastRow"
