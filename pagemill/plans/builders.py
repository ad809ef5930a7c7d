"""Composite plans: crop export, sample builders, experiment summaries, the page baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions.hashing import split_name
from pagemill.functions.text import code_point_counts, length_bucket, stripped
from pagemill.functions.tokens import tokenized
from pagemill.operators import metrics as A
from pagemill.operators import selection as L
from pagemill.operators.reading_order import assembled_texts, text_evaluable
from pagemill.operators.recognizers import recognize
from pagemill.operators.scoring import scored_pages
from pagemill.sources.readers import flat_regions, image_id


def export_decisions(pages: DataFrame, rule: L.RegionFilter = L.RegionFilter(), fraction: float = 0.2, padding: int = 8, seed: int = 42) -> DataFrame:
    """Every region of every page with image id, split, padded box and reason (null: exported)."""
    index = F.col("_row_index") if "_row_index" in pages.columns else F.lit(None).cast("long")
    p = pages.withColumn("image_id", image_id(index))
    p = p.withColumn("split", split_name(F.col("image_id"), fraction, seed))
    r = flat_regions(p).withColumn("box", G.from_numbers(F.col("region.bbox")))
    r = r.withColumn("reason", rule.reason(F.col("region.type"), F.col("region.language"), F.col("region.legibility"), F.col("region.text"), F.col("box")))
    r = r.withColumn("padded", G.padded(F.col("box"), padding, F.col("image_width"), F.col("image_height")))
    return r.withColumn("reason", F.when(F.col("region").isNull(), "no_regions").otherwise(F.coalesce("reason", F.when(F.col("padded").isNull(), "invalid_bbox_after_padding"))))


def crop_manifest(decided: DataFrame, *more: Column) -> DataFrame:
    stem = F.regexp_replace(F.substring_index("image_id", "/", -1), r"(?<=.)\.[^.]+$", "")
    name = F.format_string("%s__r%04d.png", F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), "region_index")
    keep = [c for c in ("image_width", "image_height", "source", "annotation_source", "year", "grade", "subject", "group", "fund", "content_type") if c in decided.columns]
    return decided.where("reason IS NULL").select(
        F.format_string("%s::r%04d", stem, "region_index").alias("crop_id"), "split", F.concat_ws("/", F.lit("crops"), "split", name).alias("crop_path"), "image_id", "region_index",
        F.coalesce("region.text", F.lit("")).alias("text"), F.col("region.type").alias("region_type"), "region.language", "region.legibility",
        F.array(*(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), *keep, *more,
    )


def export_counts(decided: DataFrame) -> DataFrame:
    """Counts of regions by kind: skip reasons, splits, types, sources. A page without regions counts nowhere."""
    none = lambda c, d="None": F.coalesce(c.cast("string"), F.lit(d))
    kept = F.col("reason").isNull()
    pairs = F.array(
        F.when(~kept, F.struct(F.lit("skipped").alias("kind"), none(F.col("reason")).alias("value"))),
        *(F.when(kept, F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in (("split", F.col("split")), ("region_type", none(F.col("region.type"))), ("source", none(F.col("source"), "unknown")))),
    )
    return decided.where("region IS NOT NULL").select(F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def annotate(rows: DataFrame, tokens=None) -> DataFrame:
    """exact_text, token_length (blank-separated words unless another column is given), raw_text_length, bucket."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return rows.withColumns({"exact_text": stripped(text), "token_length": tokens if tokens is not None else words, "raw_text_length": F.length(text), "text_length_bucket": length_bucket(text)})


def tokenizer_columns(rows: DataFrame, vocabulary: str) -> DataFrame:
    """annotate() by a tokenizer's tokens, with token_ids, n_unknown, decoded, roundtrip_equal and the count of replacement characters."""
    t = rows.withColumn("__t", tokenized("text", vocabulary))
    out = annotate(t, F.col("__t.n_tokens")).withColumns({"token_ids": F.col("__t.ids"), "n_unknown": F.col("__t.n_unknown"), "decoded": F.col("__t.decoded")})
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.withColumns({"roundtrip_equal": same, "n_replacement": code_point_counts(F.coalesce("text", F.lit("")))["n_replacement"]}).drop("__t")


def stage1_sample(train: DataFrame, val: DataFrame, n_train: int, n_val: int, max_tokens: int = 128, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, dropped): validation of distinct texts first, then training rows that share no text with it."""
    def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        r = annotate(rows)
        r = r.withColumn("drop_reason", L.drop_reason(F.col("text"), F.col("token_length"), max_tokens))
        return r.where("drop_reason IS NULL"), r.where("drop_reason IS NOT NULL")

    (good_t, bad_t), (good_v, bad_v) = parts(train), parts(val)
    chosen_v = L.require_rows(L.first_of_each(good_v, "exact_text", "crop_id", seed + 1, n_val), n_val, "validation")
    chosen_t = L.require_rows(L.in_shuffled_order(L.leak_free(good_t, chosen_v, "exact_text"), "crop_id", seed, n_train), n_train, "training")
    return chosen_t, chosen_v, bad_t.unionByName(bad_v)


def smoke_sample(train: DataFrame, val: DataFrame, n_train: int, n_val: int, max_tokens: int = 96, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    fit = lambda rows: annotate(rows).where(F.col("token_length") <= max_tokens)
    return L.in_shuffled_order(fit(train), "crop_id", seed, n_train), L.in_shuffled_order(fit(val), "crop_id", seed + 1, n_val)


def overfit_sample(rows: DataFrame, n_train: int, n_val: int, max_tokens: int = 128, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows and, on purpose, validation rows from among them."""
    good = annotate(rows).where((F.col("exact_text") != "") & (F.col("token_length") <= max_tokens))
    chosen = L.require_rows(L.in_shuffled_order(good, "crop_id", seed, n_train), n_train, "training")
    return chosen, L.in_shuffled_order(chosen, "crop_id", seed, n_val)


def summarize_experiment(predictions: DataFrame, k: int = 25) -> dict[str, DataFrame]:
    """overall, percentiles, histogram, error buckets, groups and the k worst rows, of enriched predictions.

    Six frames over one input: persist it before, or take datasets.experiment_summaries, which does and frees it.
    """
    keys = [c for c in ("source", "annotation_source", "region_type", "language", "legibility", "text_length_bucket", "error_buckets") if c in predictions.columns]
    return {
        "overall": predictions.agg(*A.summary()),
        "percentiles": A.nearest_ranks(predictions, "cer", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}),
        "histogram": A.rate_histogram(predictions),
        "error_buckets": predictions.select(F.explode("error_buckets").alias("label")).groupBy("label").agg(F.count("*").alias("n_rows")),
        "groups": A.grouped_summary(predictions, keys),
        "worst": A.worst(predictions, k),
    }


def page_baseline(regions: DataFrame, recognizer: str) -> DataFrame:
    """Page evaluations of a recogniser on annotated regions (page_id, region_id, box, region_type, language, legibility, text)."""
    read = recognize(regions, recognizer)
    ok = text_evaluable(F.col("region_type"), F.col("language"), F.col("legibility"))
    texts = assembled_texts(read, {"reference_text": "text", "predicted_text": "predicted_text"}, ok)  # one order serves both
    return scored_pages(texts)


def detection_scores(matches: DataFrame, n_ref: int, n_pred: int) -> dict:
    """Extension: precision, recall and F1 of greedy matches over a whole set."""
    n = matches.count()
    p, r = (n / n_pred if n_pred else 0.0), (n / n_ref if n_ref else 0.0)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def composite_score(f1: float, class_accuracy: float, cer: float, page_cer: float) -> float:
    """Extension: the weighted score the data set's documentation describes."""
    return 0.15 * f1 + 0.05 * class_accuracy + 0.30 * (1 - cer) + 0.50 * (1 - page_cer)
