"""Scores by group: micro and mean rates, percentiles, histograms, distributions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: lower ends of error-rate bins and their names
RATE_BINS = ((0.0, "0.00_0.05"), (0.05, "0.05_0.10"), (0.10, "0.10_0.25"), (0.25, "0.25_0.50"), (0.50, "0.50_1.00"), (1.0, "1.00_inf"))

#: Ranges of values, over which ranks are summed up, to a doubling of the value plus one.
RANGES = 32


def micro_rate(edits: Column, lengths: Column) -> Column:
    """All edits by all reference characters, not the mean of rates: 0.0 where rows have no characters, null where there are no rows."""
    total = F.sum(lengths)
    return F.when(total > 0, F.sum(edits).cast("double") / total).when(F.count("*") > 0, 0.0)


def summary() -> list[Column]:
    return [F.count("*").alias("n_rows"), micro_rate(F.col("edit_distance"), F.col("reference_length")).alias("micro_cer"), F.avg("cer").alias("mean_cer")]


def grouped_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One independent grouping for each key; null reads None; a list puts its row into each of its buckets."""
    kinds = dict(df.dtypes)
    plain = [k for k in keys if not kinds[k].startswith("array")]
    pick = ["cer", "edit_distance", "reference_length"]
    out = None
    if plain:  # one pass for all plain keys
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("None")).alias("bucket")) for k in plain)))
        out = df.select(*pick, each.alias("g")).select(*pick, "g.key", "g.bucket")
    for k in (k for k in keys if k not in plain):
        # explode() would filter for lists that are not empty below what makes them, and so make them twice
        rows = df.select(*pick, F.lit(k).alias("key"), F.explode_outer(F.col(k)).alias("bucket")).where("bucket IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("key", "bucket").agg(*summary())


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at rint((n - 1) * share) in order.

    Equal values are counted first. Their ranks are running sums of counts, over ranges of values and then inside a range, so
    a group is never gathered in one row and its values never pass through one task.
    """
    by = by or []
    # a range is a step of the logarithm of the value, so it needs no pass over the data and keeps the order
    step = F.signum(value) * F.floor(F.log2(1 + F.abs(value)) * RANGES)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c")).withColumn("__range", step).persist()  # read twice; a row for each different value
    ranges = counts.groupBy(*by, "__range").agg(F.sum("__c").alias("__in"))
    group = Window.partitionBy(*by)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0))).withColumn("__n", F.sum("__in").over(group))
    ranges = ranges.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), "__before", "__n")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.col("__range") == F.col("__r"))
    placed = counts.join(F.broadcast(ranges), same).drop("__r", *(f"__{c}" for c in by))
    upto = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("__to", F.col("__before") + F.sum("__c").over(upto))
    at = {name: F.rint((F.col("__n") - 1) * q) for name, q in shares.items()}
    inside = lambda r: (r < F.col("__to")) & (r >= F.col("__to") - F.col("__c"))
    return ranked.groupBy(*by).agg(F.max("__n").alias("n_rows"), *(F.max(F.when(inside(r), F.col(value))).alias(name) for name, r in at.items()))


def linear_percentiles(value: Column, shares: dict[str, float]) -> list[Column]:
    return [F.percentile(value, q).alias(name) for name, q in shares.items()]


def rate_histogram(df: DataFrame, value: str = "cer") -> DataFrame:
    """Rows in each bin, bins without rows too; 1.0 is in the last, a negative rate in none."""
    name = F.lit(None).cast("string")
    for low, label in RATE_BINS:
        name = F.when(F.col(value) >= low, label).otherwise(name)
    counts = df.select(name.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(label,) for _, label in RATE_BINS], "bin string")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n_rows"))


def worst(df: DataFrame, k: int = 25, by: tuple[str, ...] = ("cer", "reference_length"), tie: str = "crop_id") -> DataFrame:
    """The k highest rows; ties by id, in a top-k without a full sort."""
    return df.orderBy(*(F.desc(c) for c in by), tie).limit(k)


def rates_by_key(df: DataFrame, key: str = "image_id", value: str = "page_cer", position: str | None = None) -> DataFrame:
    """(key, value), one row a key; of equal keys the last by `position`, or without one the highest. Rows without a key go."""
    last = F.max_by(value, position) if position else F.max(value)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias(value))


def token_percentiles(value: Column) -> list[Column]:
    """Minimum, the percentiles that sample reports give, maximum and mean of a count; null where there are no rows."""
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return [F.min(value).alias("min"), *linear_percentiles(value, shares), F.max(value).alias("max"), F.avg(value).alias("mean")]
