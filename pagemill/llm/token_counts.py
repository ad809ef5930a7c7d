"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Every document is encoded whole; documents are aggregated by their number of tokens. From the histogram, one row per
distinct length L: documents and tokens at L, documents and tokens at or above L, the total if texts are cut to L tokens
(tokens below L plus L for each document at or above it), and the share of documents at or below L, from which every
quantile is read. So totals, quantiles and truncated totals for any limit come from the histogram alone.

Suffix sums run over blocks of 1,024 lengths first and then inside each block, so no task sees all lengths.

A null or empty text has length 0 and counts. Repeated rows count each, texts of equal length share a row. Very long texts are
encoded whole. Columns beside the text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import lean, slices, stored

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ready: dict[bytes, object] = {}


def _encoding(vocabulary: bytes):
    name = hashlib.sha256(vocabulary).digest()
    if name not in _ready:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ready[name] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ready[name]


def encoded_lengths(df: DataFrame, text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: n_tokens. The vocabulary file is read by the driver and broadcast (its size is fixed)."""
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizers, vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x)) if x else 0 for x in b.column("text").to_pylist()], pa.int64())], ["n_tokens"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From (n_tokens): length, n_docs, n_tokens, docs_from, tokens_from, truncated_total, docs_to, share_to."""
    h = stored(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    h = h.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr("length div 1024"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(blocks, "block").withColumn("docs_from", F.col("d_above") + F.sum("n_docs").over(inside)).withColumn("tokens_from", F.col("t_above") + F.sum("n_tokens").over(inside))
    docs_to = F.col("d_all") - F.col("docs_from") + F.col("n_docs")
    return h.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"), docs_to.alias("docs_to"), (docs_to / F.col("d_all")).alias("share_to"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, tokens kept when cut to it, tokens lost."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    over = F.col("length") > F.col("context_limit")
    return histogram.join(F.broadcast(asked)).groupBy("context_limit").agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
        F.sum(F.when(over, (F.col("length") - F.col("context_limit")) * F.col("n_docs")).otherwise(0)).alias("tokens_lost"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length at or below which at least that share of documents lies."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return histogram.join(F.broadcast(asked), F.col("share_to") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
