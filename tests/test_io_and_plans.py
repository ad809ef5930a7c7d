import csv
import hashlib
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions.hashing import config_hash
from pagemill.operators import detection as Dt
from pagemill.operators import errors as E
from pagemill.plans import builders as B
from pagemill.plans import inspection as I
from pagemill.sources import images as P
from pagemill.sources import provenance as V
from pagemill.sources import readers as S
from pagemill.sources import sinks as K
from pagemill.streaming.ingest import run_available, scored_stream, stream_manifest


def parts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_jsonl_has_sorted_names_and_nulls(spark, tmp_path):
    K.write_jsonl(spark.createDataFrame([(2, None, "ї")], "b int, c string, a string"), f"{tmp_path}/x")
    assert parts(tmp_path / "x") == '{"a":"ї","b":2,"c":null}\n'
    (tmp_path / "bad.jsonl").write_text('{"crop_id":"a"}\n\n{"crop_id":\n')
    with pytest.raises(Exception):
        S.read_manifest(spark, f"{tmp_path}/bad.jsonl").collect()


def test_csv_is_read_back(spark, tmp_path):
    K.write_manifest_csv(spark.createDataFrame([('say "x"\r\nand,\ny', [1, 2])], "text string, bbox array<int>").coalesce(1), f"{tmp_path}/c")
    assert list(csv.reader(io.StringIO(parts(tmp_path / "c")))) == [["bbox", "text"], ["[1,2]", 'say "x"\\nand,\\ny']]


def test_submission(spark):
    rows = spark.createDataFrame([("p", 1, "image", "t", 0, 0, 3, 3), ("p", 0, "printed", "їжа", 1, 1, 2, 2)], "image string, reading_index int, region_type string, text string, x1 int, y1 int, x2 int, y2 int")
    r = K.submission_frame(K.valid_pages(rows), F.col("image")).first()
    assert r.regions == '[{"bbox":[1,1,2,2],"type":"printed","text":"їжа"},{"bbox":[0,0,3,3],"type":"image","text":""}]'
    for bad in ("image", "region_type"):
        with pytest.raises(Exception, match="invalid region"):
            K.valid_pages(rows.withColumn(bad, F.lit(""))).collect()


def test_bytes_and_archives(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_bytes(b"ok")
    (tmp_path / "f/b.txt").write_bytes(b"x\xff\xfey")
    d = {r.path[-5:]: r for r in S.utf8_diagnostics(spark, f"{tmp_path}/f").collect()}
    assert d["a.txt"].valid and not d["b.txt"].valid and d["b.txt"].error.error_start == 1 and d["b.txt"].error.error_hex == "ff"
    sums = {r.path[-5:]: r.sha256 for r in S.file_checksums(spark, f"{tmp_path}/f").collect()}
    assert sums["a.txt"] == hashlib.sha256(b"ok").hexdigest()
    for k in "12":
        K.zip_folder(f"{tmp_path}/f", f"{tmp_path}/{k}.zip")
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    assert config_hash({"b": 1, "a": "ї"}) == hashlib.sha256('{"a":"ї","b":1}'.encode()).hexdigest()
    assert S.crop_path("/d/manifests/train.jsonl", F.lit("crops/x.png")) is not None


def test_ids_and_revisions(spark):
    rows = spark.createDataFrame([("", "0", None, 7, "/a/snapshots/r1/x"), (None, "i", "j", 8, "/a/b"), (None, None, None, 9, "/a/snapshots")], "file_name string, image_id string, id string, n long, path string")
    got = rows.select(S.image_id(F.col("n")).alias("i"), S.revision_of(F.col("path")).alias("r")).collect()
    assert [(r.i, r.r) for r in got] == [("stream_000007.jpg", "r1"), ("i", None), ("stream_000009.jpg", None)]


def test_export(spark):
    region = lambda b, t="printed", lang="uk", leg="legible", x="abc": (b, t, x, lang, leg)
    pages = spark.createDataFrame(
        [("a b.jpg", 100, 50, "s", [region([0.5, 1.5, 20.0, 30.0]), region([1.0, 2.0, 3.0]), region([300.0, 1.0, 310.0, 9.0]), region([1.0, 1.0, 5.0, 5.0], lang=None)]), ("c.jpg", 100, 50, None, [])],
        "file_name string, image_width int, image_height int, source string, regions array<struct<bbox:array<double>,type:string,text:string,language:string,legibility:string>>",
    ).withColumns({"image_id": F.lit(None).cast("string"), "id": F.lit(None).cast("string")})
    d = B.export_decisions(pages)
    assert sorted(str(r.reason) for r in d.collect()) == ["None", "excluded_language:None", "invalid_bbox", "invalid_bbox_after_padding", "no_regions"]
    m = B.crop_manifest(d).collect()
    assert [(r.crop_id, r.bbox, r.crop_path.split("/")[-1]) for r in m] == [("a b::r0000", [0, 2, 20, 30], "a_b__r0000.png")]
    assert {(r.kind, r.value): r.n for r in B.export_counts(d).collect()}["skipped", "invalid_bbox"] == 1


def test_samples_do_not_leak(spark):
    rows = [(f"c{k}", f" text {k % 37} ", f"s{k % 2}") for k in range(200)] + [("blank", "  ", "s"), ("long", "w " * 300, "s")]
    df = spark.createDataFrame(rows, "crop_id string, text string, source string")
    train, val, dropped = B.stage1_sample(df.where("crop_id < 'c5'"), df, 20, 10)
    t, v = ({r.exact_text for r in x.collect()} for x in (train, val))
    assert len(v) == 10 and not t & v and {r.drop_reason for r in dropped.collect()} == {"empty_text", "over_max_token_length"}
    again = B.stage1_sample(df.where("crop_id < 'c5'").repartition(5), df.orderBy("text"), 20, 10)
    assert {r.crop_id for r in again[0].collect()} == {r.crop_id for r in train.collect()}
    with pytest.raises(ValueError):
        B.stage1_sample(df, df, 10_000, 10)
    a, b = B.overfit_sample(df, 30, 5)
    assert {r.crop_id for r in b.collect()} <= {r.crop_id for r in a.collect()} and B.smoke_sample(df, df, 8, 4)[0].count() == 8


def predictions(spark):
    rows = [("c1", "abc", "abc", 3), ("c2", "слон", "слін", 200), ("c3", "abc", "", 1), ("c4", "a" * 100, "b", 1), ("c5", "ab", "abxyz", 1), ("c6", "x�", "x", 1), ("c7", "abcd", "..", 1)]
    return spark.createDataFrame(rows, "crop_id string, reference_text string, predicted_text string, token_length int")


def test_labels(spark):
    got = {r.crop_id: r.error_buckets for r in E.enrich(predictions(spark), 128).collect()}
    assert got["c1"] == ["exact_match"] and got["c2"] == ["truncation_failure", "cyrillic_character_confusion"]
    assert got["c3"] == ["empty_prediction", "deletion_heavy_failure"] and got["c4"] == ["long_line_collapse"] and got["c5"] == ["insertion_heavy_failure"]
    assert got["c6"] == ["invalid_unicode_reference", "deletion_heavy_failure"] and got["c7"][0] == "punctuation_only_drift"


def test_runs(spark, tmp_path):
    a = E.enrich(predictions(spark))
    b = a.withColumn("cer", F.when(F.col("crop_id") == "c3", 0.0).otherwise(F.col("cer") + 1)).where("crop_id <> 'c1'")
    c = E.compare_runs(a, b)
    s = E.comparison_summary(c).first()
    assert (s.shared, s.base_only, s.candidate_only, s.regressions, s.improvements) == (6, 1, 0, 5, 1)
    assert [r.crop_id for r in E.largest_changes(c, 2, True).collect()] == ["c2", "c4"] and E.hardest_overlap(a, b, 3).first().overlap >= 1
    out = B.summarize_experiment(a)
    assert out["overall"].first().n_rows == 7 and sum(r.n_rows for r in out["histogram"].collect()) == 7
    K.write_jsonl(predictions(spark), f"{tmp_path}/e/predictions.jsonl")
    (tmp_path / "e/metrics.json").write_text(json.dumps({"target_length_policy": {"val": {"max_target_length": 128}}}))
    e = S.read_experiment(spark, f"{tmp_path}/e")
    assert e["config"] == {} and e["predictions"].where(F.array_contains("error_buckets", "truncation_failure")).count() == 1
    K.write_error_analysis(a.withColumn("source", F.lit("s")), f"{tmp_path}/a", 2)
    assert len(parts(tmp_path / "a/hardest").splitlines()) == 2
    pages = spark.createDataFrame([("p", "a\nb", "a\nc", 1, 3, 0.5)], "image_id string, reference_text string, predicted_text string, edit_distance int, reference_length int, page_cer double")
    assert "-b\n+c" in K.hardest_pages_markdown(pages)
    last = E.last_of_each(spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], "crop_id string, pos int"), "crop_id", "pos").collect()
    assert [(r.crop_id, r.pos) for r in last] == [("k", 2)]


def test_available_files_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"crop_id": f"c{k}", "reference_text": "ab", "predicted_text": "a"}) + "\n")
        run_available(scored_stream(stream_manifest(spark, f"{tmp_path}/in", predictions(spark).schema)), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert spark.read.parquet(f"{tmp_path}/out").count() == k + 1
    assert {r.cer for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {0.5}


# Images, provenance, inspection -------------------------------------------------------------------------------------
def filtered_png(pixels, kinds):
    """A PNG whose line k is filtered by kinds[k], written from the format's definition."""
    height, width, step = pixels.shape
    flat, out = pixels.reshape(height, -1).astype(int), b""
    for y in range(height):
        left = lambda x, y=y: flat[y, x - step] if x >= step else 0
        above = lambda x, y=y: flat[y - 1, x] if y else 0
        corner = lambda x, y=y: flat[y - 1, x - step] if y and x >= step else 0

        def paeth(x, a=left, b=above, c=corner):
            far = [(abs(a(x) + b(x) - c(x) - v), k, v) for k, v in enumerate((a(x), b(x), c(x)))]
            return min(far)[2]

        guess = [lambda x: 0, left, above, lambda x, a=left, b=above: (a(x) + b(x)) // 2, paeth][kinds[y]]
        out += bytes([kinds[y], *((flat[y, x] - guess(x)) % 256 for x in range(width * step))])
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    return P.MAGIC + part(b"IHDR", head) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters(step):
    pixels = np.random.default_rng(step).integers(0, 256, (10, 7, step), dtype=np.uint8)
    got = P.decode_png(filtered_png(pixels, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    assert (got == (pixels[:, :, :3] if step >= 3 else pixels[:, :, :1])).all() and got.shape == (10, 7, 3)


def test_crops_are_cut_and_written(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    (tmp_path / "page.png").write_bytes(P.encode_png(pixels))
    (tmp_path / "bad.png").write_bytes(b"no image")
    seen = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in P.read_images(spark, str(tmp_path)).collect()}
    assert seen == {"page.png": (40, 30), "bad.png": (None, None)}
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("x1", 5), ("y1", 6), ("x2", 15), ("y2", 9))))
    crops = P.read_images(spark, str(tmp_path)).select(P.crop_png("content", box).alias("png"), F.lit("crops/train/a__r0000.png").alias("crop_path"))
    assert P.write_crops(crops, str(tmp_path / "out")) == 1
    assert (P.decode_png((tmp_path / "out/crops/train/a__r0000.png").read_bytes()) == pixels[6:9, 5:15]).all()
    assert P.head_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x20\x00\x10\x01\x00\x00\x00") == (16, 32) and P.head_size(None) is None


def test_provenance(tmp_path):
    made = V.trace("e1", {"b": 1, "a": "ї"}, split_artifacts=[{"name": "train", "path": "x.jsonl", "seed": 42}], preprocessing={"version": "1", "transforms": [{"type": "crop"}]})
    K.write_json(made, f"{tmp_path}/t/trace.json")
    got = json.loads((tmp_path / "t/trace.json").read_text())
    assert got["config_hash"] == hashlib.sha256('{"a":"ї","b":1}'.encode()).hexdigest() and got["split_artifacts"][0]["seed"] == 42 and got["preprocessing"]["notes"] is None
    assert got["metadata"] == {} and got["split_artifacts"][0]["sha256"] is None
    for bad in ({"confg": {}}, {"split_artifacts": [{"name": "train"}]}):
        with pytest.raises(ValueError):
            V.trace("e1", {}, **bad)
    V.write_experiment_metadata(str(tmp_path), {"x": 1}, {"rows": 2})
    got = json.loads((tmp_path / "metadata.json").read_text())
    assert got["config"] == {"x": 1} and got["metrics"] == {} and got["runtime"]["packages"]["pyspark"] and V.checked_out("/") is None
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/packed-refs").write_text("# pack\n" + "a" * 40 + " refs/heads/main\n")
    assert V.checked_out(str(tmp_path)) == "a" * 40
    (tmp_path / ".git/refs/heads/main").write_text("b" * 40 + "\n")
    assert V.checked_out(str(tmp_path / "t")) == "b" * 40
    assert V.version_within("4.10.1", least="4.9") and V.version_within("2", least="2.0.0") and not V.version_within("2.0", below="2") and V.version_within("1.9.9+cu1", below="2")
    assert not V.version_within(None, below="9") and not V.version_within("dev", below="9") and V.version_within("0.0", below="1")


def test_crop_analysis(spark):
    kind = "crop_id string, image_id string, text string, source string, crop_width int, crop_height int"
    train = spark.createDataFrame([("a", "1", "x", "s", 10, 20), ("b", "1", "x", None, 30, 40), ("c", "2", "zz", "s", 5, 5)], kind)
    val = spark.createDataFrame([("d", "3", "x", "s", 1, 1), ("e", "3", "w", "s", 2, 2)], kind)
    got = I.crop_analysis(train, val)
    assert tuple(got["train_totals"].first()) == (3, 2, 0, 0) and got["val_rows_in_train"].first().n_rows == 1 and [r.text for r in got["top_overlaps"].collect()] == ["x"]
    numbers = {r.measure: r for r in got["train_numbers"].collect()}
    assert set(numbers) == {"text_length", "crop_width", "crop_height", "crop_area"} and (numbers["crop_area"].min, numbers["crop_area"].p50, numbers["crop_area"].max) == (25, 200, 1200)
    assert {(r.key, r.value): r.n_rows for r in got["train_counts"].collect()} == {("source", "s"): 2, ("source", "None"): 1, ("text_length_bucket", "000_005"): 3}
    lost = I.split_profile(train, tokens=F.length("text"), unknown=F.when(F.col("text") == "x", 2))["totals"].first()
    assert (lost.rows_with_unknown, lost.unknown_tokens) == (2, 4)


def test_unicode_inspection(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"crop_id":"a","text":"\\u0007x\ufffd"}\n{"crop_id":"b","text":null}\n', encoding="utf-8")
    got = I.unicode_inspection(spark, f"{tmp_path}/p.jsonl", ["text", "absent"], limit=1)
    assert [tuple(r) for r in got["totals"].collect()] == [("text", 1, 1)] and got["rows"].count() == 1 and got["file"].first().n_replacement == 1
    assert got["rows"].orderBy("crop_id").first().text.unicode.length in (3, 4)
    bad = I.round_trip_failures(spark.createDataFrame([("a", "x"), ("b", "Y"), ("c", None)], "crop_id string, text string"), F.lower("text")).collect()
    assert [r.crop_id for r in bad] == ["b"] and bad[0].decoded_unicode.repr == "'y'"


def test_text_is_detected(spark):
    page = np.full((300, 400, 3), 250, np.uint8)
    for y, x1, x2 in ((40, 50, 200), (120, 60, 180), (200, 50, 350)):
        for x in range(x1, x2, 9):  # strokes of a line
            page[y : y + 14, x : x + 4] = 20
    page[0:2, 0:400] = 0  # a scan's dark rim
    page[250:253, 200:203] = 0  # a speck
    got = spark.createDataFrame([(P.encode_png(page),), (None,), (b"x",)], "png binary").select(Dt.detect_text("png").alias("d")).collect()
    boxes = [tuple(d.bbox) for d in got[0].d]
    assert len(boxes) == 3 and got[1].d == [] and got[2].d == [] and {d.type for d in got[0].d} == {"text"}
    for (x1, y1, x2, y2), (y, a, b) in zip(boxes, ((40, 50, 200), (120, 60, 180), (200, 50, 350))):
        assert abs(x1 - a) < 12 and abs(x2 - b) < 12 and abs(y1 - y) < 8 and abs(y2 - y - 14) < 8


def test_outer_boxes_match_a_flood_fill():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.4, 0.6):
        mask = rng.random((14, 17)) < share
        field = np.pad(mask, 1)

        def flood(start, same, steps, field=field):
            seen, todo = {start}, [start]
            while todo:
                y, x = todo.pop()
                for dy, dx in steps:
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < field.shape[0] and 0 <= p[1] < field.shape[1] and p not in seen and field[p] == same:
                        seen.add(p)
                        todo.append(p)
            return seen

        four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
        outside, left, want = flood((0, 0), False, four), {tuple(p) for p in np.argwhere(field)}, set()
        while left:
            part = flood(next(iter(left)), True, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
            left -= part
            if any((y + a, x + b) in outside for y, x in part for a, b in four):
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                want.add((min(xs) - 1, min(ys) - 1, max(xs), max(ys)))
        assert set(Dt.outer_boxes(mask)) == want


def test_boxes_are_drawn(spark):
    page = np.zeros((20, 30, 3), np.uint8)
    kind = "png binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>, colours array<string>"
    rows = [(P.encode_png(page), [(2, 3, 12, 13), (25, 15, 99, 99)], ["ff0000", "00ff00"]), (P.encode_png(page), None, None), (None, [(1, 1, 2, 2)], ["ffffff"])]
    a, b, c = (P.decode_png(r.v) for r in spark.createDataFrame(rows, kind).coalesce(1).select(P.overlay_png("png", "boxes", "colours").alias("v")).collect())
    assert (a[3, 2:12, 0] == 255).all() and (a[12, 2:12, 0] == 255).all() and a[8, 7].sum() == 0 and a[2].sum() == 0 and a[15, 29, 1] == 255
    assert b.sum() == 0 and c is None
