"""Scored rows of a crop that come again replace the earlier ones: keyed state holds each crop's last row over micro-batches.

What comes out are changes: the row that goes with n = -1 and negated numbers, the row that comes with n = 1. Their sums by any of
the columns are those of the last rows, whatever batches the input came in, so a sink only appends and a reader only adds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LAST = "position long, edit_distance long, reference_length long, text_length_bucket string"
CHANGES = "crop_id string, text_length_bucket string, n long, edit_distance long, reference_length long"

# Spark plans stateful processors in a worker that does not see shipped packages: they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LastRow(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        new = old
        for frame in rows:
            for r in frame[["position", "edit_distance", "reference_length", "text_length_bucket"]].itertuples(index=False, name=None):
                r = (int(r[0]), int(r[1]), int(r[2]), r[3])
                new = r if new is None or r > new else new
        if new == old:
            return
        self.last.update(new)
        signed = [(row, sign) for row, sign in ((old, -1), (new, 1)) if row is not None]
        yield pd.DataFrame([(key[0], row[3], sign, sign * row[1], sign * row[2]) for row, sign in signed], columns=["crop_id", "text_length_bucket", "n", "edit_distance", "reference_length"])

    def close(self) -> None:
        pass


def last_row_changes(scored: DataFrame, position: str) -> DataFrame:
    """Changes of a stream of scored rows (see ingest.scored_stream); `position`, a column, says which row of a crop is the last.

    Of equal positions the greatest numbers count, so the order of arrival never does. Rows without a crop or a position go; nulls
    in the numbers count as 0 and a null bucket as ''. The state is one small row a crop, in the executors' RocksDB and the
    checkpoint.
    """
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = scored.select(
        F.col("crop_id").cast("string").alias("crop_id"),
        F.col(position).cast("long").alias("position"),
        *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("edit_distance", "reference_length")),
        F.coalesce("text_length_bucket", F.lit("")).alias("text_length_bucket"),
    ).where("crop_id IS NOT NULL AND position IS NOT NULL")
    return rows.groupBy("crop_id").transformWithStateInPandas(LastRow(), CHANGES, "Append", "None")


def current_rates(changes: DataFrame, *by: str) -> DataFrame:
    """Counts and micro rates of the last rows, from all changes so far; groups that no crop is in any more go."""
    sums = changes.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "edit_distance", "reference_length")))
    return sums.where("n > 0").withColumn("cer", F.when(F.col("reference_length") > 0, F.col("edit_distance").cast("double") / F.col("reference_length")))
