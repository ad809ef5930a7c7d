"""Input order: the place of a row in its files, counted over all files in order of their paths, without a shuffle of the rows.

Parquet rows know their index in the file (`_metadata.row_index`). Lines of text know the block of the file they were read from
(`_metadata.file_block_start`), and inside a block they come in order, so their place is told by an id that rises inside a
task. One row for each file, or block, is counted and summed up; the rows get their file's or block's start by a join with that
small table, broadcast while the files are few enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row of some hundred bytes a file is broadcast up to so many files.
BROADCAST_FILES = 100_000


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums of n: over the blocks of a file inside it, over the files by one row each (the driver lists the same files)."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.groupBy("file_").agg(F.sum("n").alias("n")).select(F.col("file_").alias("f_"), before(Window.orderBy("file_")).alias("start"))
    if len(keys) == 1:
        return files.withColumnRenamed("f_", "file_")
    blocks = counts.withColumn("inside", before(Window.partitionBy("file_").orderBy("block_")))
    return blocks.join(files, F.col("file_") == F.col("f_")).select(*keys, "first_", (F.col("start") + F.col("inside")).alias("start"))


def _placed(rows: DataFrame, counts: DataFrame, keys: list[str], at: Column, name: str, files: int) -> DataFrame:
    starts = _starts(counts, keys).withColumnsRenamed({k: f"{k}of" for k in keys})
    starts = F.broadcast(starts) if files <= BROADCAST_FILES else starts
    same = [rows[k] == starts[f"{k}of"] for k in keys]
    place = (F.col("start") + at).cast("long")
    out = rows.join(starts, same)
    if name in rows.columns:  # a row that has a place keeps it
        return out.withColumn(name, F.coalesce(F.col(name).cast("long"), place)).drop(*keys, *starts.columns, "at_")
    return out.withColumn(name, place).drop(*keys, *starts.columns, "at_")


def parquet_in_order(df: DataFrame, name: str = "_row_index", limit: int | None = None) -> DataFrame:
    """A frame read from Parquet files, with each row's place from 0; `limit` keeps the first so many. A place that a row has stays."""
    meta, files = df.metadataColumn("_metadata"), len(df.inputFiles())
    rows = df.select("*", meta.getField("file_path").alias("file_"), meta.getField("row_index").alias("at_"))
    counts = rows.groupBy("file_").agg((F.max("at_") + 1).alias("n"))
    if limit is None:
        return _placed(rows, counts, ["file_"], F.col("at_"), name, files)
    out = _placed(rows, counts, ["file_"], F.col("at_"), "place_", files).where(F.col("place_") < limit)
    out = out.withColumn(name, F.coalesce(F.col(name).cast("long"), "place_") if name in df.columns else F.col("place_"))
    return out.drop("place_")


def lines_in_order(spark: SparkSession, path: str, name: str = "_row_index", limit: int | None = None) -> DataFrame:
    """(value, place) of all lines of text files, blank ones too; `limit` keeps the first so many lines."""
    df = spark.read.text(path)
    meta = df.metadataColumn("_metadata")
    rows = df.select("value", meta.getField("file_path").alias("file_"), meta.getField("file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"))
    counts = rows.groupBy("file_", "block_").agg(F.min("at_").alias("first_"), F.count("*").alias("n"))
    out = _placed(rows, counts, ["file_", "block_"], F.col("at_") - F.col("first_"), name, len(df.inputFiles()))
    return out if limit is None else out.where(F.col(name) < limit)
