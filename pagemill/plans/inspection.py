"""Profiles of manifests and texts: split statistics, train/validation analysis, Unicode inspection, tokenizer round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import metrics as A
from pagemill.operators import selection as L
from pagemill.sources.readers import utf8_diagnostics

SHARES = {"min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}
KEYS = ("source", "region_type", "language", "legibility", "annotation_source")


def split_numbers(rows: DataFrame, values: dict[str, Column], *by: str) -> DataFrame:
    """Long form (by.., measure, n_rows, min .. max, mean) of numeric measures: one pass, exact linear percentiles."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items())))
    long = rows.select(*by, pairs.alias("p")).select(*by, "p.*")
    return long.groupBy(*by, "measure").agg(F.count("value").alias("n_rows"), *A.linear_percentiles(F.col("value"), SHARES), F.avg("value").alias("mean"))


def split_counts(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(key, value, n_rows) for every key that the rows have, and for the buckets of text length; a null reads as None."""
    named = {k: F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys if k in rows.columns} | {"text_length_bucket": X.length_bucket(F.coalesce("text", F.lit("")))}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named.items())))
    return rows.select(pairs.alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n_rows"))


def split_profile(rows: DataFrame, tokens: Column | None = None, unknown: Column | None = None) -> dict[str, DataFrame]:
    """totals (rows, images, rows and tokens unknown to a tokenizer), numbers and counts of one manifest.

    `tokens` and `unknown` are columns of token counts and of unknown tokens; crop sizes are profiled where the rows have them.
    """
    values = {"text_length": F.length("text")}
    if tokens is not None:
        values["token_length"] = tokens
    if {"crop_width", "crop_height"} <= set(rows.columns):
        values |= {"crop_width": F.col("crop_width"), "crop_height": F.col("crop_height"), "crop_area": F.col("crop_width") * F.col("crop_height")}
    lost = F.coalesce(unknown, F.lit(0)) if unknown is not None else F.lit(0)
    totals = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("image_id").alias("n_images"), F.count_if(lost > 0).alias("rows_with_unknown"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("unknown_tokens"))
    return {"totals": totals, "numbers": split_numbers(rows, values), "counts": split_counts(rows)}


def crop_analysis(train: DataFrame, val: DataFrame, k: int = 50) -> dict[str, DataFrame]:
    """Profiles of both splits, their shared texts, validation rows whose text is in train, and the k most frequent shared texts."""
    count = lambda df, name: df.groupBy("text").agg(F.count("*").alias(name))
    both = count(train, "n_train").join(count(val, "n_val"), "text").withColumn("n_total", F.col("n_train") + F.col("n_val"))
    shared = L.overlap(train, val, "text")
    return {
        **{f"train_{name}": df for name, df in split_profile(train).items()},
        **{f"val_{name}": df for name, df in split_profile(val).items()},
        "shared_texts": shared,
        "val_rows_in_train": val.join(train.select("text").distinct(), "text", "left_semi").agg(F.count("*").alias("n_rows")),
        "top_overlaps": both.orderBy(F.desc("n_total"), F.desc("text")).limit(k),
    }


def unicode_inspection(spark: SparkSession, path: str, fields: list[str], limit: int = 20) -> dict[str, DataFrame]:
    """A JSON-lines file: its bytes, replacement and control characters of each field over all rows, the first rows in full."""
    rows = spark.read.option("mode", "FAILFAST").json(path)
    have = [f for f in fields if f in rows.columns]
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None"))
    counts = [F.struct(F.lit(f).alias("field"), *(X.code_point_counts(text(f))[c].alias(c) for c in ("n_replacement", "n_control"))) for f in have]
    totals = rows.select(F.explode(F.array(*counts)).alias("c")).groupBy("c.field").agg(F.sum("c.n_replacement").alias("n_replacement"), F.sum("c.n_control").alias("n_control")) if have else spark.createDataFrame([], "field string, n_replacement long, n_control long")
    first = rows.limit(limit).select(*(["crop_id"] if "crop_id" in rows.columns else []), *(F.struct(text(f).alias("raw"), X.unicode_summary(text(f)).alias("unicode")).alias(f) for f in have))
    return {"file": utf8_diagnostics(spark, path), "totals": totals, "rows": first}


def round_trip_failures(rows: DataFrame, decoded: Column, text: str = "text", key: str = "crop_id") -> DataFrame:
    """Rows whose text a tokenizer does not give back, with both texts taken apart; `decoded` is a column of the text decoded again."""
    tried = rows.select(key, F.col(text).alias("text"), decoded.alias("decoded"))
    return tried.where(~F.col("text").eqNullSafe(F.col("decoded"))).select("*", X.unicode_summary("text").alias("reference_unicode"), X.unicode_summary("decoded").alias("decoded_unicode"))
