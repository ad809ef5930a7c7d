"""Page evaluation: reference and prediction pages joined, texts assembled in reading order and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import edit_distance
from pagemill.operators.errors import last_of_each
from pagemill.operators.metrics import micro_rate
from pagemill.operators.reading_order import order_regions, page_texts


def ordered_page_texts(regions: DataFrame, evaluable: Column, text: str, page: str = "page_id", region: str = "region_id") -> DataFrame:
    return page_texts(order_regions(regions, page, region), evaluable, page, text)


def evaluate_pages(reference: DataFrame, prediction: DataFrame, page: str = "page_id", strict: bool = True, position: str | None = None) -> DataFrame:
    """One row for each reference page: texts, edit_distance, reference_length, page_cer. Extra predictions are ignored.

    Of several predictions of a page the last counts, by `position`; without one pages have to be unique. A page without a
    prediction raises, or with strict=False is scored as empty.
    """
    p = (last_of_each(prediction, page, position) if position else prediction).select(page, F.col("page_text").alias("predicted_text"), F.lit(True).alias("__there"))
    both = reference.select(page, F.col("page_text").alias("reference_text")).join(p, page, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("missing prediction for page "), F.col(page).cast("string")))
        both = both.withColumn("predicted_text", F.when(F.col("__there"), F.col("predicted_text")).otherwise(missing))
    return scored_pages(both.drop("__there"))


def scored_pages(texts: DataFrame) -> DataFrame:
    """Pages with reference_text and predicted_text, and edit_distance, reference_length, page_cer; a null text is empty."""
    ref, pred = F.coalesce("reference_text", F.lit("")), F.coalesce("predicted_text", F.lit(""))
    scored = texts.withColumns({"edit_distance": edit_distance(ref, pred), "reference_length": F.length(ref).cast("long")})
    rate = F.when(F.col("reference_length") > 0, F.col("edit_distance").cast("double") / F.col("reference_length")).otherwise((F.length(pred) > 0).cast("double"))
    return scored.withColumn("page_cer", rate)


def mean_page_rate(pages: DataFrame, *by: str) -> DataFrame:
    return pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.sum("edit_distance").alias("edit_distance"), F.sum("reference_length").alias("reference_length"), micro_rate(F.col("edit_distance"), F.col("reference_length")).alias("page_cer"))
