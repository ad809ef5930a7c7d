"""Incremental ingest: new manifest files since the last run go through the same expressions, then the query stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import error_rate, length_bucket


def stream_manifest(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def scored_stream(stream: DataFrame) -> DataFrame:
    ref, pred = F.coalesce("reference_text", F.lit("")), F.coalesce("predicted_text", F.lit(""))
    return stream.withColumns({"edit_distance": F.levenshtein(ref, pred), "reference_length": F.length(ref), "cer": error_rate(ref, pred), "text_length_bucket": length_bucket(ref)})


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append it as Parquet, stop. The checkpoint makes a rerun take up only new files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_values(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: tumbling sums of an event stream by type; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
