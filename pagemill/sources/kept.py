"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session of one machine may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.conf.get("spark.master", None) or ""):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """A table written once and read back: what is read twice is the same both times, whatever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/pagemill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
