"""Plans that write whole results, page frames, lookups, discovery and tokenizer columns."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions.tokens import tokenized
from pagemill.operators import errors as E
from pagemill.operators import metrics as A
from pagemill.operators import reading_order as R
from pagemill.operators.recognizers import recognize, register
from pagemill.operators.scoring import evaluate_pages
from pagemill.plans import datasets as D
from pagemill.plans import inspection as I
from pagemill.sources import images as P
from pagemill.sources import readers as S
from pagemill.sources import sinks as K

KIND = "crop_id string, crop_path string, text string, source string, region_type string, language string, annotation_source string, image_id string"


def crops(spark, n=60):
    return spark.createDataFrame([(f"c{k:03d}", f"crops/all/c{k:03d}.png", f"text {k % 17} of some length", f"s{k % 2}", "printed", "uk", None, f"i{k % 7}") for k in range(n)] + [("blank", "crops/all/blank.png", " ", "s", "printed", "uk", None, "i")], KIND)


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_crops_are_evaluated(spark, tmp_path):
    folder = tmp_path / "run"
    metrics = D.evaluate_crops(crops(spark), "empty", str(folder), "m.jsonl", hardest=5)
    assert metrics["rows"] == 61 and metrics["overall"]["micro_cer"] == 1.0 and metrics["grouped"]["source"]["s0"]["rows"] == 30
    assert json.loads((folder / "metrics.json").read_text())["manifest"] == "m.jsonl" and len(lines(folder / "predictions")) == 61 and len(lines(folder / "hardest_examples")) == 5
    text = (folder / "hardest_examples.md").read_text()
    assert text.startswith("# Hardest OCR Crop Examples") and "- CER: 1.000000" in text and text.count("## ") == 5
    assert D.evaluate_crops(crops(spark), "oracle", str(tmp_path / "r2"))["overall"]["mean_cer"] == 0.0
    assert D.crop_metrics(D.evaluated_crops(crops(spark).limit(0), "empty"), "m", "")["overall"] == {"rows": 0, "micro_cer": None, "mean_cer": None}
    told = D.crop_analysis_markdown(I.crop_analysis(crops(spark), crops(spark, 5)), "words")
    assert "- Train rows: 61" in told and "- Val rows whose text appears in train: 6" in told


def test_samples_are_written_to_the_end(spark, tmp_path):
    pixels = P.encode_png(np.zeros((3, 4, 3), np.uint8))
    (tmp_path / "src/crops/all").mkdir(parents=True)
    for k in range(60):
        (tmp_path / f"src/crops/all/c{k:03d}.png").write_bytes(pixels)
    images = P.read_images(spark, str(tmp_path / "src")).select("path", "content")
    rows = crops(spark)
    stats = D.write_stage1_dataset(rows.where("crop_id < 'c040'"), rows, str(tmp_path / "one"), 12, 8, images, archive=True)
    assert stats["overlap"] == {"raw_exact_text_overlap_count": 17, "selected_exact_text_overlap_count": 0} and stats["selected"]["train"]["rows"] == 12
    manifest = lines(tmp_path / "one/manifests/train")
    assert len(manifest) == 12 and all((tmp_path / "one" / r["crop_path"]).read_bytes() == pixels for r in manifest)
    sums = json.loads((tmp_path / "one/checksums.json").read_text())
    assert "FILTERING_POLICY.md" in sums and sum(x.startswith("crops/") for x in sums) == 20
    with zipfile.ZipFile(tmp_path / "one.zip") as z:
        assert all(n.startswith("one/") for n in z.namelist()) and "one/dataset_info.json" in z.namelist()
    smoke = D.write_smoke_dataset(rows, rows, str(tmp_path / "two"), 10, 4)
    assert smoke["train_size"] == 10 and sum(smoke["source_counts"]["train"].values()) == 10 and smoke["token_length"]["min"] >= 1
    fit = D.write_overfit_dataset(rows, str(tmp_path / "three"), 8, 3, decoded=F.upper("text"))
    assert fit["tokenizer_roundtrip_failures"] == 11 and fit["reference_replacement_char_count"] == 0 and fit["val_token_length"]["max"] == 5
    trip = lines(tmp_path / "three/diagnostics/tokenizer_roundtrip")
    assert len(trip) == 11 and not any(r["roundtrip_equal"] for r in trip) and all(r["text"] for r in lines(tmp_path / "three/diagnostics/reference_integrity"))
    D.require_leak_free(rows.where("crop_id = 'c001'"), rows.where("crop_id = 'c002'"), "text")
    with pytest.raises(ValueError):
        D.require_leak_free(rows, rows, "text")
    assert D.experiment_summaries(spark, D.evaluated_crops(rows, "empty"))["overall"][0]["n_rows"] == 61


def test_outside_images(spark):
    page = np.full((300, 400, 3), 250, np.uint8)
    for y, x1, x2 in ((40, 50, 200), (120, 60, 180)):
        for x in range(x1, x2, 9):
            page[y : y + 14, x : x + 4] = 20
    register("measured", lambda image, text: F.struct(F.concat_ws("x", P.image_size(image).width, P.image_size(image).height).alias("text"), F.lit(0.5).alias("score"), F.create_map().cast("map<string,string>").alias("metadata")))
    images = spark.createDataFrame([("d/a.png", P.encode_png(page), 400, 300), ("d/none.png", P.encode_png(np.full((50, 50, 3), 250, np.uint8)), 50, 50)], "path string, content binary, width int, height int")
    regions, pages = D.read_outside_images(images, "measured")
    rows = regions.orderBy("reading_index").collect()
    assert len(rows) == 2 and [r.reading_index for r in rows] == [0, 1] and all(P.head_size(r.crop) and r.predicted_text == "{}x{}".format(*P.head_size(r.crop)) for r in rows)
    got = {r.image_id: r for r in pages.collect()}
    assert got["a.png"].page_text == "\n".join(r.predicted_text for r in rows) and got["none.png"].n_regions == 0 and got["none.png"].page_text == ""
    assert (P.decode_png(got["a.png"].overlay) != page).any()


def test_page_frames_lookups_and_profiles(spark):
    image = P.encode_png(np.zeros((7, 9, 3), np.uint8))
    pages = spark.createDataFrame([("a", image, 0, None, 0), ("b", image, 5, 6, 1), (None, image, None, None, 2)], "file_name string, image binary, image_width int, image_height int, _row_index long").withColumns({c: F.lit(None).cast("string") for c in ("image_id", "id")})
    assert [(r.image_id, r.image_width, r.image_height) for r in D.page_frame(pages).orderBy("_row_index").collect()] == [("a", 9, 7), ("b", 5, 6), ("stream_000002.jpg", 9, 7)]
    with pytest.raises(Exception, match="without an id"):
        D.page_frame(pages.drop("_row_index")).collect()
    regions = spark.createDataFrame([(1, 0, 0, 0, 5, 5, "x", "printed", 9, 7, image), (1, 1, 5, 5, 9, 9, None, "printed", 9, 7, image)], "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long, text string, region_type string, image_width int, image_height int, image binary")
    assert [P.head_size(r.crop) for r in D.cropped(regions, padding=1).orderBy("region_id").collect()] == [(6, 6), (5, 3)]
    assert recognize(D.cropped(regions), "oracle", "crop").where("predicted_text = 'x'").count() == 1
    found = D.by_box(regions, regions.where("region_id = 0")).orderBy("region_id").collect()
    assert [(r.found, r.agrees) for r in found] == [(True, True), (False, False)]
    with pytest.raises(Exception, match="no region"):
        D.regions_by_id(spark.createDataFrame([(1, 0, [0, 7])], "page_id long, line_index int, region_ids array<long>"), regions.select("page_id", "region_id", "text")).collect()
    kept, told = R.ordered_pages(regions.unionByName(regions.where("region_id = 0").withColumn("region_id", F.lit(9).cast("long"))).select("page_id", "region_id", "x1", "y1", "x2", "y2", "text"))
    one = told.first()
    assert (one.input_regions, one.suppressed_duplicates, one.line_count) == (3, 1, 2) and [tuple(e) for e in one.events] == [("duplicate_suppressed", "9", "0")]
    assert {r.line_id for r in kept.collect()} == {r.line_id for r in R.lines(kept).collect()} and kept.select("line_id").distinct().count() == 2
    assert D.rows_to_render(spark.createDataFrame([("b", ["truncation_failure"]), ("a", ["x"])], "crop_id string, error_buckets array<string>"), "truncation").count() == 1


def test_numbers_discovery_and_probing(spark, tmp_path):
    rows = spark.range(500).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 7 = 0 THEN 'same' ELSE concat('k', id) END AS k", "id")
    got = S.numbered(rows, "k").orderBy("_row_index").collect()
    assert [r._row_index for r in got] == list(range(500))
    keys = [r.k for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or ""))
    held = S.numbered(rows.withColumn("_row_index", F.when(F.col("id") == 3, 77).cast("long")), "k").where("id = 3").first()
    assert held._row_index == 77
    rows.limit(5).write.parquet(f"{tmp_path}/set/main/train")
    rows.limit(5).write.parquet(f"{tmp_path}/set/main/test")
    assert {(r.config, r.split) for r in S.discover_splits(spark, f"{tmp_path}/set").collect()} == {("main", "train"), ("main", "test")}
    assert S.read_pages(spark, f"{tmp_path}/set", "train", order="id", config="main").count() == 5
    assert S.probed_columns(rows, {"id": ("page_id", "ID"), "text": ("text",)}) == {"id": "id", "text": None}
    paths = spark.createDataFrame([("/a/b", 0), ("/a/snapshots/r2/x", 2), ("/a/snapshots/r1/x", 1)], "path string, _row_index long")
    assert S.first_revision(paths).first()[0] == "r1" and S.first_revision(paths.where("_row_index = 0")).first()[0] is None


def test_last_rows_win_and_nulls(spark):
    ref = spark.createDataFrame([(1, "a")], "page_id long, page_text string")
    pred = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (None, "x", 2)], "page_id long, page_text string, at int")
    assert [r.page_cer for r in evaluate_pages(ref, pred, position="at").collect()] == [0.0]
    base = spark.createDataFrame([("k", 0.1, "r", 0), ("k", 0.5, "r2", 1), (None, 0.9, "r", 2), ("only", 0.0, "o", 3)], "crop_id string, cer double, reference_text string, at int")
    other = spark.createDataFrame([("k", 0.25, "r2", 0), (None, 1.0, "z", 1), ("new", 0.0, "n", 2)], "crop_id string, cer double, reference_text string, at int")
    both = E.compare_runs(base, other, position="at")
    assert {r.crop_id: (r.base_cer, r.candidate_cer, r.delta, r.reference_text) for r in both.collect()} == {"k": (0.5, 0.25, -0.25, "r2"), "only": (0.0, None, None, "o"), "new": (None, 0.0, None, "n")}
    assert tuple(E.comparison_summary(both).first()) == (1, 1, 1, -0.25, 0, 1)
    rows = spark.createDataFrame([("c", "abc", "abd")], "crop_id string, text string, predicted_text string")
    assert E.enrich(rows).first().cer == pytest.approx(1 / 3)  # the text is the reference where no other is named
    kept = E.enrich(rows.withColumn("cer", F.lit(None).cast("double"))).first()
    assert kept.cer is None and kept.edit_distance == 1  # a column that is there stays as it is
    twice = spark.createDataFrame([("p", 0.5, 1), ("p", 0.25, 2), (None, 1.0, 3)], "image_id string, page_cer double, at int")
    assert [tuple(r) for r in A.rates_by_key(twice, position="at").collect()] == [("p", 0.25)]
    assert spark.createDataFrame([], "cer double, edit_distance long, reference_length long").agg(*A.summary()).first().micro_cer is None
    values = [float(x) for x in (3, 1, 1, 2, 9, 9, 9, 4)]
    got = A.nearest_ranks(spark.createDataFrame([(v,) for v in values], "cer double"), "cer", {"p50": 0.5, "p90": 0.9}).first()
    assert (got.n_rows, got.p50, got.p90) == (8, sorted(values)[round(7 * 0.5)], sorted(values)[round(7 * 0.9)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokenizer_columns(spark, name):
    df = spark.createDataFrame([("a", "plain words"), ("b", "слон ☃"), ("c", None)], "crop_id string, text string").withColumn("t", tokenized("text", f"/opt/tokenizers/{name}"))
    got = {r.crop_id: r.t for r in df.collect()}
    assert all(len(t.ids) == t.n_tokens for t in got.values()) and got["c"].n_tokens == 0 and got["a"].decoded.strip() == "plain words"
    assert name != "byte_bpe_50k.tiktoken" or (got["b"].decoded == "слон ☃" and got["b"].n_unknown == 0)


def test_rows_are_annotated_by_a_tokenizer(spark):
    from pagemill.plans.builders import tokenizer_columns

    rows = spark.createDataFrame([("a", "Plain  words", "i"), ("b", "x\ufffd", "i"), ("c", None, "j")], "crop_id string, text string, image_id string")
    got = {r.crop_id: r for r in tokenizer_columns(rows, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert all(r.roundtrip_equal and r.token_length == len(r.token_ids) for r in got.values()) and got["b"].n_replacement == 1 and got["c"].token_length == 0
    lower = tokenizer_columns(rows, "/opt/tokenizers/word_bpe_49k.json")
    assert {r.crop_id for r in I.round_trip_failures(lower, F.col("decoded")).collect()} >= {"a"} and "totals" in I.split_profile(lower, F.col("token_length"), F.col("n_unknown"))


def test_failures_as_one_array(spark, tmp_path):
    df = spark.createDataFrame([("p", None), ("q", 1)], "page string, n int")
    assert K.write_failure_array(df, f"{tmp_path}/f.json") == 2 and {r["page"]: r["n"] for r in json.loads((tmp_path / "f.json").read_text())} == {"p": None, "q": 1}
    with pytest.raises(ValueError):
        K.write_failure_array(df, f"{tmp_path}/g.json", 1)


def test_export_analysis_and_baseline_are_written(spark, tmp_path):
    region = lambda b, x: (b, "printed", x, "uk", "legible")
    image = P.encode_png(np.full((50, 100, 3), 7, np.uint8))
    pages = spark.createDataFrame([(f"p{k}.png", image, "s", [region([1.0, 2.0, 30.0, 20.0], "abc"), region([1.0, 2.0, 3.0], "bad")]) for k in range(6)], "file_name string, image binary, source string, regions array<struct<bbox:array<double>,type:string,text:string,language:string,legibility:string>>")
    pages = pages.withColumns({"image_id": F.lit(None).cast("string"), "id": F.lit(None).cast("string"), "image_width": F.lit(0), "image_height": F.lit(0)})
    stats = D.write_crop_export(pages, str(tmp_path / "x"), fraction=0.4)
    assert stats["crops"] == stats["crops_written"] == 6 and stats["counts"]["skipped"] == {"invalid_bbox": 6} and len(lines(tmp_path / "x/stats/split_manifest")) == 6
    assert P.head_size(next((tmp_path / "x/crops").rglob("*.png")).read_bytes()) == (38, 28)
    found = D.write_experiment_analysis(D.evaluated_crops(crops(spark), "empty"), str(tmp_path / "a"))
    assert found["overall"][0]["n_rows"] == 61 and json.loads((tmp_path / "a/summary.json").read_text())["overall"][0]["micro_cer"] == 1.0
    rows = spark.createDataFrame([(1, 0, 0, 0, 5, 5, "x", "printed", "uk", None), (2, 0, 0, 0, 5, 5, "y", "printed", None, None)], "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long, text string, region_type string, language string, legibility string")
    assert D.write_page_baseline(rows, "oracle", str(tmp_path / "b")) == {"pages": 2, "mean_page_cer": 0.0}
    assert {r["page_id"]: r["page_cer"] for r in lines(tmp_path / "b/page_cer_by_image")} == {1: 0.0, 2: 0.0} and (tmp_path / "b/hardest_pages.md").exists()
    (tmp_path / "c.json").write_text(json.dumps({"fraction": 0.3, "seed": 7}))
    assert S.configured(spark, f"{tmp_path}/c.json", D.write_crop_export) == {"fraction": 0.3, "seed": 7}
    (tmp_path / "d.json").write_text(json.dumps({"seed": "seven"}))
    with pytest.raises(ValueError, match="seed"):
        S.configured(spark, f"{tmp_path}/d.json", D.write_crop_export)
