"""Filters with reasons, hash splits, leak-free samples."""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.hashing import group_key, shuffle_key, split_name
from pagemill.functions.text import stripped
from pagemill.sources.readers import numbered


@dataclass(frozen=True)
class RegionFilter:
    """What a region must be to be exported; an empty tuple of languages or legibilities turns that test off."""

    types: tuple[str, ...] = ("handwritten", "printed")
    languages: tuple[str, ...] = ("uk",)
    legibility: tuple[str, ...] = ("legible",)
    min_length: int = 1
    max_length: int | None = None

    def reason(self, region_type: Column, language: Column, legibility: Column, text: Column, box: Column) -> Column:
        """The first test that fails, or null; the text is not stripped."""
        none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
        n = F.length(F.coalesce(text, F.lit("")))
        out = F.when(~none(region_type).isin(*self.types), F.concat(F.lit("excluded_type:"), none(region_type)))
        if self.languages:
            out = out.when(~none(language).isin(*self.languages), F.concat(F.lit("excluded_language:"), none(language)))
        if self.legibility:
            out = out.when(~none(legibility).isin(*self.legibility), F.concat(F.lit("excluded_legibility:"), none(legibility)))
        out = out.when(n < self.min_length, "empty_or_too_short_text")
        if self.max_length is not None:
            out = out.when(n > self.max_length, "too_long_text")
        return out.when(box.isNull(), "invalid_bbox")


def drop_reason(text: Column, tokens: Column, most: int) -> Column:
    """empty_text, over_max_token_length or null."""
    return F.when(stripped(F.coalesce(text, F.lit(""))) == "", "empty_text").when(tokens > most, "over_max_token_length")


def validation_keys(df: DataFrame, fields: list[str], fraction: float, seed: int) -> DataFrame:
    """(group_key): the distinct keys of these fields that a hash puts into the validation split; rows of one key never part."""
    keys = df.select(group_key(*fields).alias("group_key")).distinct()
    return keys.where(split_name(F.col("group_key"), fraction, seed) == "val")


def in_shuffled_order(df: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Rows in a reproducible random order; with n the first n (top-k, no full sort)."""
    out = df.orderBy(shuffle_key(F.col(key), seed), F.col(key))
    return out if n is None else out.limit(n)


def in_seeded_order(df: DataFrame, key: str, seed: int, n: int | None = None, most: int = 5_000_000) -> DataFrame:
    """Rows sorted by key, then in the order that random.Random(seed).shuffle gives them, as `shuffled` from 0; with n the first n.

    The permutation is one of the generator's own and has to be drawn as a whole, 8 bytes a row, so more rows than `most` raise. The rows
    themselves are numbered by ranges of their keys and joined to it; in_shuffled_order() has no such bound.
    """
    spark, rows = df.sparkSession, numbered(df, key, "sorted_")
    m = rows.count()
    if m > most:
        raise ValueError(f"{m} rows; a seeded permutation is drawn for {most} at most")
    drawn = list(range(m))
    random.Random(seed).shuffle(drawn)
    table = pd.DataFrame({"at_": drawn[:n], "shuffled": range(len(drawn[:n]))}, dtype="int64")
    order = spark.createDataFrame(table, "at_ long, shuffled long")
    return rows.join(order, F.col("sorted_") == F.col("at_")).drop("sorted_", "at_")


def first_of_each(df: DataFrame, by: str, key: str, seed: int, n: int | None = None) -> DataFrame:
    """One row for each value of `by`, the first in shuffled order, then the first n of these."""
    place = F.struct(shuffle_key(F.col(key), seed).alias("shuffled"), F.col(key).alias("key"))
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), place)  # combined before the shuffle, however frequent a value
    first = df.groupBy(F.col(by).alias("by_")).agg(row.alias("row_"), F.min(place).alias("place_"))
    return (first.orderBy("place_").limit(n) if n is not None else first).select("row_.*")


def leak_free(train: DataFrame, val: DataFrame, by: str) -> DataFrame:
    """Training rows whose `by` value no validation row has."""
    return train.join(val.select(by).distinct(), by, "left_anti")


def overlap(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Values of `by` on both sides with both counts."""
    return a.groupBy(by).agg(F.count("*").alias("n_a")).join(b.groupBy(by).agg(F.count("*").alias("n_b")), by)


def require_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    if (got := df.count()) < n:
        raise ValueError(f"{what}: {got} rows, {n} asked for")
    return df


def target_lengths(df: DataFrame, most: int, allow: bool = False, examples: int = 20) -> dict:
    """Rows over a token limit: raises unless allowed, else a summary."""
    over = df.where(F.col("token_length") > most)
    total, n, longest = df.agg(F.count("*"), F.count_if(F.col("token_length") > most), F.max("token_length")).first()
    if n and not allow:
        raise ValueError(f"{n} rows are longer than {most} tokens")
    return {"rows": total, "over": n, "longest": longest, "coverage_pct": 100.0 * (total - n) / total if total else None, "examples": [r.asDict() for r in over.orderBy(F.desc("token_length"), "crop_id").limit(examples).collect()]}
