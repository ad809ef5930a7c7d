"""Whole plans that write: crop evaluation, sample data sets with reports, copies and archives, pages of outside images."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions.text import nfc, stripped, unicode_summary
from pagemill.operators import metrics as A
from pagemill.operators import selection as L
from pagemill.operators.detection import detect_text
from pagemill.operators.errors import enrich
from pagemill.operators.reading_order import assembled_texts, order_regions
from pagemill.operators.recognizers import recognize
from pagemill.plans.builders import crop_manifest, export_counts, export_decisions, overfit_sample, page_baseline, smoke_sample, stage1_sample, summarize_experiment
from pagemill.sources.images import crop_png, image_size, overlay_png, write_crops
from pagemill.sources.kept import kept
from pagemill.sources.provenance import write_experiment_metadata
from pagemill.sources.readers import file_checksums, image_id
from pagemill.sources.sinks import hardest_pages_markdown, rekeyed, submission_frame, write_error_analysis, write_json, write_jsonl, write_splits, write_submission, zip_folder

GROUPS = ("source", "region_type", "language", "annotation_source", "text_length_bucket")


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row else {}


# ---- pages and lookups ---------------------------------------------------------------------------------------------
def page_frame(pages: DataFrame) -> DataFrame:
    """Pages with image_id and a size: image_width and image_height where they are there and not 0, else those of the image's head."""
    index = F.col("_row_index") if "_row_index" in pages.columns else F.lit(None).cast("long")
    size = image_size("image") if "image" in pages.columns else F.lit(None).cast("struct<width:int,height:int>")
    named = pages.withColumn("image_id", image_id(index)).withColumn("__s", size)
    side = lambda c, own: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"__s.{own}"))
    return named.withColumns({"image_width": side("image_width", "width"), "image_height": side("image_height", "height")}).drop("__s")


def cropped(regions: DataFrame, image: str = "image", padding: int = 0) -> DataFrame:
    """Adds crop, the pixels of each region's padded box, for recognisers that read pixels: recognize(.., image="crop")."""
    box = G.padded(G.box("x1", "y1", "x2", "y2"), padding, F.col("image_width"), F.col("image_height"))
    return regions.withColumn("crop", crop_png(F.col(image), box))


def by_box(reference: DataFrame, prediction: DataFrame, page: str = "page_id") -> DataFrame:
    """Each reference region with the text of the prediction of exactly its box on its page, and whether both texts agree.

    Of several predictions of one box the last by region_id counts.
    """
    box = ["x1", "y1", "x2", "y2"]
    last = prediction.groupBy(F.col(page).alias("page_"), *(F.col(c).alias(f"{c}_") for c in box)).agg(F.max_by("text", "region_id").alias("predicted_text"), F.lit(True).alias("found"))
    same = [F.col(page) == F.col("page_"), *(F.col(c) == F.col(f"{c}_") for c in box)]
    out = reference.join(last, same, "left").drop("page_", *(f"{c}_" for c in box))
    return out.withColumns({"found": F.coalesce("found", F.lit(False)), "agrees": F.coalesce(F.col("found") & F.col("text").eqNullSafe(F.col("predicted_text")), F.lit(False))})


def regions_by_id(lines: DataFrame, regions: DataFrame, page: str = "page_id", region: str = "region_id") -> DataFrame:
    """Lines (page, line_index, region_ids) with their regions, one row each, in order; an unknown id raises."""
    asked = lines.select(page, "line_index", F.posexplode("region_ids").alias("within_line_index", "id_"))
    own = regions.withColumnsRenamed({page: "page_"}).withColumn("there_", F.lit(True))
    out = asked.join(own, (F.col(page) == F.col("page_")) & (F.col("id_") == F.col(region)), "left")
    missing = F.raise_error(F.concat(F.lit("no region "), F.col("id_").cast("string")))
    return out.withColumn(region, F.when(F.col("there_"), F.col("id_")).otherwise(missing)).drop("page_", "id_", "there_")


def data_profile(pages: DataFrame, split: str = "split") -> DataFrame:
    """Images, annotated images, regions, mean sizes and text lengths of each split."""
    n = F.coalesce(F.size("regions"), F.lit(0))
    lengths = F.transform(F.coalesce("regions", F.array().cast(pages.schema["regions"].dataType)), lambda r: F.length(F.coalesce(r["text"], F.lit(""))))
    rows = pages.select(F.col(split).alias("split"), "image_width", "image_height", F.greatest(n, F.lit(0)).alias("n"), lengths.alias("l"))
    total = F.sum(F.aggregate("l", F.lit(0), lambda a, v: a + v))
    return rows.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(F.col("n") > 0).alias("annotated_images"), F.sum("n").alias("regions"), F.avg("n").alias("mean_regions"),
        F.avg("image_width").alias("mean_width"), F.avg("image_height").alias("mean_height"), (total / F.nullif(F.sum("n"), F.lit(0))).alias("mean_text_length"),
        F.sum(F.size(F.filter("l", lambda v: v == 0))).alias("empty_text_regions"),
    )


def rows_to_render(predictions: DataFrame, mode: str, limit: int = 20) -> DataFrame:
    """The rows that a picture grid shows: hardest (rate, then length), truncation, or the first by id."""
    if mode == "hardest":
        return A.worst(predictions, limit)
    rows = predictions.where(F.array_contains("error_buckets", "truncation_failure")) if mode == "truncation" else predictions
    return rows.orderBy("crop_id").limit(limit)


# ---- reports -------------------------------------------------------------------------------------------------------
def _fenced(title: str, text: str | None) -> list[str]:
    return [f"{title}:", "", "```text", text or "", "```", ""]


def hardest_crops_markdown(rows: DataFrame, k: int = 20) -> str:
    """A report on the k crops of highest rate; only these come to the driver."""
    out = ["# Hardest OCR Crop Examples", ""]
    for r in A.worst(rows, k, ("cer",)).collect():
        r = r.asDict()
        facts = (("CER", f"{r['cer']:.6f}"), ("Source", r.get("source")), ("Type", r.get("region_type")), ("Crop", f"`{r.get('crop_path')}`"))
        out += [f"## {r['crop_id']}", "", *(f"- {k}: {v}" for k, v in facts), "", *_fenced("Reference", r["reference_text"]), *_fenced("Prediction", r["predicted_text"])]
    return "\n".join(out)


def crop_analysis_markdown(analysis: dict[str, DataFrame], tokenizer: str) -> str:
    """Rows, shared texts and token lengths of an analysis of two manifests."""
    rows = {s: _one(analysis[f"{s}_totals"])["n_rows"] for s in ("train", "val")}
    lines = ["# OCR Crop Analysis", "", f"Model/tokenizer: `{tokenizer}`", "", "## Summary", "", *(f"- {s.capitalize()} rows: {n}" for s, n in rows.items())]
    lines += [f"- Exact train/val text overlap strings: {analysis['shared_texts'].count()}", f"- Val rows whose text appears in train: {_one(analysis['val_rows_in_train'])['n_rows']}", "", "## Token Length Percentiles", ""]
    for s in rows:
        for r in analysis[f"{s}_numbers"].where("measure = 'token_length'").collect():
            lines.append(f"- {s}: p50 {r['p50']}, p95 {r['p95']}, p99 {r['p99']}, max {r['max']}")
    return "\n".join(lines) + "\n"


def _text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


# ---- crop evaluation -----------------------------------------------------------------------------------------------
def evaluated_crops(crops: DataFrame, recognizer: str, image: str = "image") -> DataFrame:
    """Crops (manifest columns and, for models, their image) read and scored: texts, distance, rate, lengths, buckets, labels."""
    return enrich(recognize(crops.withColumn("reference_text", F.col("text")), recognizer, image))


def crop_metrics(scored: DataFrame, model: str, manifest: str, whole: dict | None = None) -> dict:
    """Overall and by each grouping key; a few values on the driver. whole: the overall figures where they are known already."""
    grouped: dict[str, dict] = {}
    for r in A.grouped_summary(scored, [k for k in GROUPS if k in scored.columns]).orderBy("key", "bucket").collect():
        grouped.setdefault(r["key"], {})[r["bucket"]] = {"rows": r["n_rows"], "micro_cer": r["micro_cer"], "mean_cer": r["mean_cer"]}
    whole = whole or _one(scored.agg(*A.summary()))
    return {"rows": whole["n_rows"], "model_name": model, "manifest": manifest, "overall": {"rows": whole["n_rows"], "micro_cer": whole["micro_cer"], "mean_cer": whole["mean_cer"]}, "grouped": grouped}


def evaluate_crops(crops: DataFrame, recognizer: str, folder: str, manifest: str = "", hardest: int = 50, image: str = "image") -> dict:
    """predictions, metrics, the hardest rows as lines and as Markdown, and the run's metadata.

    Recogniser and scores run once, while their rows are written; the overall figures are observed in that write.
    """
    overall = Observation("overall")
    scored = kept(evaluated_crops(crops, recognizer, image).drop(image, "edits").observe(overall, *A.summary()), "scored")
    metrics = crop_metrics(scored, recognizer, manifest, overall.get)
    write_json(metrics, f"{folder}/metrics.json")
    write_jsonl(scored, f"{folder}/predictions")
    write_jsonl(A.worst(scored, hardest, ("cer",)), f"{folder}/hardest_examples")
    _text(f"{folder}/hardest_examples.md", hardest_crops_markdown(scored, min(hardest, 20)))
    write_experiment_metadata(folder, {"recognizer": recognizer, "hardest": hardest}, {"manifest": manifest}, metrics)
    return metrics


# ---- export, experiments, the page baseline ------------------------------------------------------------------------
def export_table(decided: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Decided regions, without pixels, as a stored table that every sink reads, and the figures observed while it was written.

    images: pages, those without regions too; regions; crops: regions that are exported.
    """
    seen = Observation("export")
    first = F.coalesce("region_index", F.lit(0)) == 0
    rows = decided.drop("image").observe(seen, F.count_if(first).alias("images"), F.count_if(F.col("region").isNotNull()).alias("regions"), F.count_if(F.col("reason").isNull()).alias("crops"))
    return kept(rows, "export"), seen.get


def write_crop_export(pages: DataFrame, folder: str, rule: L.RegionFilter = L.RegionFilter(), fraction: float = 0.2, padding: int = 8, seed: int = 42) -> dict:
    """The crop export to the end: manifests by split, crops where pages have images, split of every page, counts and checksums.

    The pages are read once for everything but pixels, and once for the pixels of crops if they have any.
    """
    decided = export_decisions(page_frame(pages), rule, fraction, padding, seed)
    table, seen = export_table(decided)
    manifest = crop_manifest(table)
    write_splits(manifest, f"{folder}/manifests")
    write_jsonl(table.select("image_id", "split").distinct(), f"{folder}/stats/split_manifest")
    written = 0
    if "image" in decided.columns:
        pixels = crop_manifest(decided, crop_png("image", F.col("padded")).alias("png")).select("crop_path", "png")
        written = write_crops(pixels, folder)
    counts: dict[str, dict[str, int]] = {}
    for r in export_counts(table).orderBy("kind", "value").collect():
        counts.setdefault(r["kind"], {})[r["value"]] = r["n"]
    stats = {"images": seen["images"], "crops": seen["crops"], "crops_written": written, "counts": counts, "seed": seed, "validation_fraction": fraction}
    write_json(stats, f"{folder}/stats/export_stats.json")
    write_experiment_metadata(folder, {"fraction": fraction, "padding": padding, "seed": seed}, {"pages": stats["images"]}, stats)
    return stats


def write_experiment_analysis(predictions: DataFrame, folder: str, k: int = 25) -> dict:
    """Summary, hardest, longest, repeated, truncated and representative rows of a run."""
    rows = kept(predictions, "predictions")
    found = experiment_summaries(rows.sparkSession, rows, k)
    write_json(found, f"{folder}/summary.json")
    write_error_analysis(rows, folder, k)
    return found


def write_page_baseline(regions: DataFrame, recognizer: str, folder: str, page: str = "page_id") -> dict:
    """Page rates of a recogniser: submission, page texts, metrics with the rate of each page, and the hardest pages."""
    seen = Observation("pages")
    judged = kept(page_baseline(regions, recognizer).observe(seen, F.count("*").alias("pages"), F.avg("page_cer").alias("mean_page_cer")), "judged")
    metrics = seen.get
    write_json(metrics, f"{folder}/metrics.json")
    write_jsonl(A.rates_by_key(judged, page), f"{folder}/page_cer_by_image")  # a row a page: a table, not an object of the driver's
    write_jsonl(judged, f"{folder}/page_texts")
    read = recognize(regions, recognizer).withColumn("text", F.col("predicted_text"))
    write_submission(submission_frame(order_regions(read), F.col(page).cast("string")), f"{folder}/submission")
    _text(f"{folder}/hardest_pages.md", hardest_pages_markdown(judged.withColumn("image_id", F.col(page).cast("string"))))
    return metrics


# ---- sample data sets ----------------------------------------------------------------------------------------------
def _counts(rows: DataFrame, key: str) -> dict[str, int]:
    return {r["value"]: r["n_rows"] for r in A.distribution(rows, key).orderBy("value").collect()}


def _write(folder: str, name: str, description: str, splits: dict[str, DataFrame], images: DataFrame | None, stats: dict, archive: bool, more: dict | None = None) -> dict:
    """Manifests, copied crops, statistics, description, checksums and an archive of a sample of stated size."""
    spark = next(iter(splits.values())).sparkSession
    rows = {s: rekeyed(df, s).persist() for s, df in splits.items()}
    try:
        for s, df in rows.items():
            write_jsonl(df.coalesce(1), f"{folder}/manifests/{s}")
            if images is not None:  # path, content of the crops that the manifests name
                source = splits[s].select("crop_id", F.col("crop_path").alias("from_"))
                to = df.select(F.col("crop_id").alias("id_"), "crop_path").join(source, F.col("id_") == F.col("crop_id")).drop("crop_id", "id_")
                # by the files' names, an equality, and then by the whole of the manifest's path
                last = lambda c: F.substring_index(c, "/", -1)
                found = images.withColumn("name_", last("path")).join(to.withColumn("name_", last("from_")), "name_")
                found = found.where(F.concat(F.lit("/"), "path").endswith(F.concat(F.lit("/"), "from_")))
                write_crops(found.select("crop_path", F.col("content").alias("png")), folder)
        write_jsonl(rows["train"].unionByName(rows["val"], allowMissingColumns=True).coalesce(1), f"{folder}/manifests/all")
        write_json(stats, f"{folder}/stats/{name}_dataset_stats.json")
        write_json({"name": Path(folder).name, "description": description, "train_manifest": "manifests/train", "val_manifest": "manifests/val", "stats": f"stats/{name}_dataset_stats.json"} | (more or {}), f"{folder}/dataset_info.json")
        sums = {r["path"].split(f"{Path(folder).name}/", 1)[-1]: r["sha256"] for r in file_checksums(spark, folder).orderBy("path").collect()}
        write_json(sums, f"{folder}/checksums.json")
        if archive:
            zip_folder(folder, f"{folder}.zip")
        return stats
    finally:
        for df in rows.values():
            df.unpersist()


def write_stage1_dataset(train: DataFrame, val: DataFrame, folder: str, n_train: int, n_val: int, images: DataFrame | None = None, tokenizer: str = "words", max_tokens: int = 128, seed: int = 42, archive: bool = False) -> dict:
    """The stage-1 sample to the end: leak-free splits, dropped rows, overlap and coverage figures, policy, checksums, archive."""
    chosen_t, chosen_v, dropped = stage1_sample(train, val, n_train, n_val, max_tokens, seed)
    chosen_t, chosen_v, dropped = chosen_t.persist(), chosen_v.persist(), dropped.persist()
    try:
        over = dropped.where("drop_reason = 'over_max_token_length'")
        write_jsonl(over.orderBy(F.desc("token_length"), "crop_id").limit(200), f"{folder}/stats/dropped_overlength_examples")
        texts = lambda df: df.select(stripped(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''").distinct()
        shared = lambda a, b: texts(a).intersect(texts(b)).count()
        sizes = {"train": (train.count(), chosen_t), "val": (val.count(), chosen_v)}
        stats = {
            "name": Path(folder).name, "model_name": tokenizer, "seed": seed, "requested_train_size": n_train, "requested_val_size": n_val,
            "target_length_policy": {"max_token_length": max_tokens, "silent_truncation_allowed": False, "dropped_over_max_token_length": over.count()},
            "overlap": {"raw_exact_text_overlap_count": shared(train, val), "selected_exact_text_overlap_count": shared(chosen_t, chosen_v)},
            "input": {"dropped": _counts(dropped, "drop_reason")} | {f"{s}_rows": n for s, (n, _) in sizes.items()},
            "selected": {s: {"rows": df.count(), "token_length": _one(df.agg(*A.token_percentiles(F.col("token_length"))))} | {f"{k}_counts": _counts(df, k) for k in (*GROUPS[:4], "text_length_bucket") if k in df.columns} for s, (_, df) in sizes.items()},
        }
        _text(f"{folder}/FILTERING_POLICY.md", "\n".join(["# Stage-1 OCR Filtering Policy", "", f"- Tokenizer/model: `{tokenizer}`", f"- Max target token length: `{max_tokens}`", "- Empty texts and texts over that length are dropped, none is cut.", "- Validation rows are chosen first, one of each text; training rows share no text with them.", "- The order is a digest of seed and `crop_id`.", ""]))
        return _write(folder, "stage1", "Stage-1 subset whose splits share no text.", {"train": chosen_t, "val": chosen_v}, images, stats, archive, {"filtering_policy": {"max_token_length": max_tokens, "empty_text": "drop", "over_max_token_length": "drop"}})
    finally:
        for df in (chosen_t, chosen_v, dropped):
            df.unpersist()


def write_smoke_dataset(train: DataFrame, val: DataFrame, folder: str, n_train: int, n_val: int, images: DataFrame | None = None, tokenizer: str = "words", max_tokens: int = 96, seed: int = 42, archive: bool = False) -> dict:
    """A small sample of both splits with counts by source and type."""
    splits = dict(zip(("train", "val"), (df.persist() for df in smoke_sample(train, val, n_train, n_val, max_tokens, seed)), strict=True))
    try:
        both = splits["train"].unionByName(splits["val"])
        stats = {"model_name": tokenizer, "seed": seed, "max_token_length_policy": max_tokens} | {f"{s}_size": df.count() for s, df in splits.items()}
        stats |= {"token_length": _one(both.agg(*A.token_percentiles(F.col("token_length")))), "text_length": _one(both.agg(*A.token_percentiles(F.length("text"))))}
        stats |= {f"{k}_counts": {s: _counts(df, k) for s, df in splits.items()} for k in ("source", "region_type") if k in both.columns}
        return _write(folder, "smoke", "Small sample for smoke runs.", splits, images, stats, archive)
    finally:
        for df in splits.values():
            df.unpersist()


def write_overfit_dataset(rows: DataFrame, folder: str, n_train: int, n_val: int, images: DataFrame | None = None, decoded: Column | None = None, tokenizer: str = "words", max_tokens: int = 128, seed: int = 42, archive: bool = False) -> dict:
    """A tiny sample whose validation rows are training rows, with each text taken apart and, for a `decoded` column, its round trip."""
    splits = dict(zip(("train", "val"), (df.persist() for df in overfit_sample(rows, n_train, n_val, max_tokens, seed)), strict=True))
    try:
        named = None
        for s, df in splits.items():
            part = df.withColumn("split_", F.lit(s)).withColumn("decoded", decoded if decoded is not None else nfc("text"))
            named = part if named is None else named.unionByName(part)
        told = named.select(F.col("split_").alias("split"), "crop_id", "text", "decoded", (F.col("decoded") == F.col("text")).alias("roundtrip_equal"), unicode_summary("text").alias("unicode"), unicode_summary("decoded").alias("decoded_unicode")).persist()
        write_jsonl(told.drop("decoded", "roundtrip_equal", "decoded_unicode"), f"{folder}/diagnostics/reference_integrity")
        write_jsonl(told.drop("unicode"), f"{folder}/diagnostics/tokenizer_roundtrip")
        found = _one(told.agg(F.sum("unicode.n_replacement").alias("reference_replacement_char_count"), F.count_if(~F.col("roundtrip_equal")).alias("tokenizer_roundtrip_failures")))
        stats = {"name": Path(folder).name, "model_name": tokenizer, "seed": seed, "val_is_train_subset": True, "max_token_length": max_tokens} | found
        stats |= {f"{s}_size": df.count() for s, df in splits.items()} | {f"{s}_token_length": _one(df.agg(F.min("token_length").alias("min"), F.max("token_length").alias("max"), F.avg("token_length").alias("mean"))) for s, df in splits.items()}
        told.unpersist()
        return _write(folder, "overfit", "Tiny sample for overfitting on purpose; validation repeats training rows.", splits, images, stats, archive)
    finally:
        for df in splits.values():
            df.unpersist()


# ---- outside images ------------------------------------------------------------------------------------------------
def read_outside_images(images: DataFrame, recognizer: str, padding: int = 4) -> tuple[DataFrame, DataFrame]:
    """Images (path, content, width, height): text found, cut out, read and ordered. (regions with crops, pages with text and overlay)."""
    found = images.select(F.substring_index("path", "/", -1).alias("page_id"), F.col("content").alias("image"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), detect_text("content").alias("d"))
    rows = found.select("page_id", "image", "image_width", "image_height", F.posexplode("d").alias("region_id", "r"))
    rows = rows.select("*", F.col("r.type").alias("region_type"), *(F.col(f"r.bbox.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), F.lit(None).cast("string").alias("text")).drop("r")
    read = recognize(cropped(rows, padding=padding), recognizer, "crop").drop("image")
    texts = assembled_texts(read, {"page_text": "predicted_text"}, F.lit(True))
    boxes = F.transform("d", lambda r: r.bbox)
    shown = found.select(F.col("page_id").alias("p_"), "image_width", "image_height", F.size("d").alias("n_regions"), overlay_png("image", boxes, F.transform("d", lambda r: F.lit("00a000"))).alias("overlay"))
    pages = shown.join(texts, F.col("p_") == F.col("page_id"), "left").select(F.col("p_").alias("image_id"), "image_width", "image_height", "n_regions", F.coalesce("page_text", F.lit("")).alias("page_text"), "overlay")
    return order_regions(read), pages


def experiment_summaries(spark: SparkSession, predictions: DataFrame, k: int = 25) -> dict[str, list[dict]]:
    """summarize_experiment as values, its frames read from one persisted table that is freed at the end."""
    kept = predictions.persist()
    try:
        return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in summarize_experiment(kept, k).items()}
    finally:
        kept.unpersist()


def require_leak_free(train: DataFrame, val: DataFrame, by: str = "exact_text") -> None:
    """Raises where a sample's splits share a value."""
    if n := L.overlap(train, val, by).limit(1).count():
        raise ValueError(f"{n} value of {by} is in both splits")
