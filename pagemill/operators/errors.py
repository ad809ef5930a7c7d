"""Error labels of predictions, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import edit_distance, edit_profile, error_rate, length_bucket, punctuation_only, repeats_itself, stripped
from pagemill.operators.metrics import worst


def reference(columns: list[str]) -> F.Column:
    """reference_text, or text in rows that have no such column; a null is empty."""
    return F.coalesce(F.col("text" if "reference_text" not in columns and "text" in columns else "reference_text"), F.lit(""))


def error_labels(max_tokens: int | None = None, tokens: str | None = None, profiled: bool = True, ref: F.Column | None = None) -> F.Column:
    """Labels of a row in order; other_ocr_error or exact_match where none applies. profiled: the edit counts are there."""
    ref = F.coalesce(F.col("reference_text"), F.lit("")) if ref is None else ref
    pred = F.coalesce(F.col("predicted_text"), F.lit(""))
    n, m = F.length(ref), F.length(pred)
    label = lambda test, name: F.when(test, F.lit(name))
    found = []
    if max_tokens is not None and tokens is not None:
        found.append(label(F.col(tokens) > max_tokens, "truncation_failure"))
    found += [
        label(stripped(pred) == "", "empty_prediction"),
        label(repeats_itself(pred), "repeated_token_degeneration"),
        label(punctuation_only(ref, pred), "punctuation_only_drift"),
        label(F.contains(pred, F.lit("�")), "invalid_unicode_output"),
        label(F.contains(ref, F.lit("�")), "invalid_unicode_reference"),
    ]
    if profiled:
        found.append(label(F.col("edits.cyrillic_substitutions") > 0, "cyrillic_character_confusion"))
    found.append(label((n >= 80) & (m <= F.greatest(F.lit(10), F.floor(n * 0.4))), "long_line_collapse"))
    if profiled:
        i, d, s = (F.col(f"edits.{x}") for x in ("insertions", "deletions", "substitutions"))
        size = F.greatest(F.lit(1), n)
        found += [label((i / size >= 0.35) & (i > d + s), "insertion_heavy_failure"), label((d / size >= 0.35) & (d > i + s), "deletion_heavy_failure")]
    labels = F.array_compact(F.array(*found))
    return F.when(F.size(labels) > 0, labels).when(F.col("cer") > 0, F.array(F.lit("other_ocr_error"))).otherwise(F.array(F.lit("exact_match")))


def enrich(df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Rate, distance, lengths and bucket where the columns are missing; edit counts and labels always anew."""
    ref, pred = reference(df.columns), F.coalesce(F.col("predicted_text"), F.lit(""))
    if "cer" not in df.columns or "edit_distance" not in df.columns:
        df = df.withColumn("distance_", edit_distance(ref, pred).cast("int"))  # once for both
    made = {"cer": error_rate(ref, pred, F.col("distance_")), "edit_distance": F.col("distance_"), "reference_length": F.length(ref), "prediction_length": F.length(pred), "text_length_bucket": length_bucket(ref)}
    df = df.withColumns({k: v for k, v in made.items() if k not in df.columns}).drop("distance_")
    tokens = next((c for c in ("reference_token_length", "token_length") if c in df.columns), None)
    df = df.withColumn("edits", edit_profile(ref, pred))
    return df.withColumn("error_buckets", error_labels(max_tokens, tokens, ref=ref))


def last_of_each(df: DataFrame, key: str, position: str | None) -> DataFrame:
    """Of rows with one key the last; rows without a key go. Aggregated before the shuffle, so a frequent key is no hot one."""
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), position)
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_")).agg(last.alias("row_")).select("row_.*")


def compare_runs(base: DataFrame, candidate: DataFrame, key: str = "crop_id", position: str | None = None) -> DataFrame:
    """Every key of either run with both rates, texts and buckets and delta = candidate - base (null unless in both).

    Rows without a key go. Where a run has a key several times its last row counts, by `position`, a column of both runs;
    without one the keys have to be unique.
    """
    carried = ("reference_text", "predicted_text", "text_length_bucket", "error_buckets", "reference_length", "source")

    def side(df: DataFrame, name: str) -> DataFrame:
        pick = [key, "cer", *(c for c in carried if c in df.columns and c != key)]  # no other column goes through the shuffle of a run's keys
        if position:
            pick += [] if position in pick else [position]
            df = last_of_each(df.select(*pick), key, position)
        else:
            df = df.where(F.col(key).isNotNull())
        return df.select(F.col(key).alias(f"{name}_key"), F.col("cer").alias(f"{name}_cer"), *(F.col(c).alias(f"{name}_{c}") for c in carried if c in df.columns))

    both = side(base, "base").join(side(candidate, "candidate"), F.col("base_key") == F.col("candidate_key"), "full_outer")
    given = [c for c in ("reference_text", "text_length_bucket", "reference_length", "source") if f"base_{c}" in both.columns or f"candidate_{c}" in both.columns]
    one = {c: F.coalesce(*(F.col(f"{s}_{c}") for s in ("base", "candidate") if f"{s}_{c}" in both.columns)) for c in given}
    out = both.withColumns({key: F.coalesce("base_key", "candidate_key"), "delta": F.col("candidate_cer") - F.col("base_cer"), **one})
    return out.select(key, *one, *(c for c in both.columns if not c.endswith("_key") and c.split("_", 1)[1] not in one), "delta")


def comparison_summary(compared: DataFrame) -> DataFrame:
    in_base, in_candidate = F.col("base_cer").isNotNull(), F.col("candidate_cer").isNotNull()
    return compared.agg(
        F.count("delta").alias("shared"),
        F.count_if(in_base & ~in_candidate).alias("base_only"),
        F.count_if(~in_base & in_candidate).alias("candidate_only"),
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("regressions"),
        F.count_if(F.col("delta") < 0).alias("improvements"),
    )


def largest_changes(compared: DataFrame, k: int, worse: bool, key: str = "crop_id") -> DataFrame:
    rows = compared.where(F.col("delta") > 0 if worse else F.col("delta") < 0)
    return rows.orderBy(F.desc("delta") if worse else F.asc("delta"), key).limit(k)


def hardest_overlap(base: DataFrame, candidate: DataFrame, k: int, key: str = "crop_id") -> DataFrame:
    """How many of the k rows of highest rate of both runs are the same; equal rates are taken by key."""
    top = lambda df: worst(df, k, ("cer",), key).select(key)
    return top(base).intersect(top(candidate)).agg(F.count("*").alias("overlap"))
