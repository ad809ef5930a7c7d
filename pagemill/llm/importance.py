"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A text's features are all runs of one and two words (lower-cased A-Z; ASCII letters and digits and every character beyond ASCII make
words), each counted as often as it stands there. A feature's bucket is the crc32 of its bytes modulo `buckets`. The corpus and the
target hold s and t features of a bucket, S and T in all; a bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).
Postings (bucket, document, count) are shuffled by bucket, each range of buckets works out its gains from the totals of both corpora
that meet it there and sends contributions, which are added by document. A document's weight is the floored mean gain of its
features; with Gumbel noise from a digest of its id, the highest `share` percent of the documents with `shortest` words or more are a sample
without replacement by importance.

crc32 is linear: a pair's code comes from the codes of its words by tables for the later word's length, so that no pair's bytes are read.

Null and empty texts, and those without words, have no features and weight 0. Repeated rows count each in the corpus and get a rank
each. A null id has a null score, is never drawn and does not count among the documents to draw from. Equal scores
go by id, then by what else is known of the row. Very long texts are read whole, a text at a time. Columns beside id and
text are not read, whatever their names. An empty table gives no rows; an empty target gives t = T = 0.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import _LOWER, cleared, keyed, lean, slices, spans, stored, utf8
from pagemill.llm.postings import KIND, answered, gathered, opened, pack, slice_rows, totals

RANGES = 16
SLICE = 4 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@functools.cache
def _table() -> np.ndarray:
    """What a byte does to the register of crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


@functools.cache
def _shifts(longest: int = 64) -> np.ndarray:
    """[length, byte of the register, value]: the register after `length` zero bytes."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _table()[out[n - 1] & np.uint32(255)]
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte run: all runs take their next byte at once, runs of over 64 bytes go one by one."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    long = np.flatnonzero(size > 64)
    order = np.argsort(np.where(size > 64, 0, -size), kind="stable")
    at, left = starts[order], -np.sort(-np.where(size > 64, 0, size), kind="stable")
    register, table = np.full(len(order), 0xFFFFFFFF, np.uint32), _table()
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # the runs of more than k bytes stand first
        r = register[:n]
        register[:n] = table[(r ^ data[at[:n] + k]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def joined_crcs(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of first + second, from both codes and the second's size in bytes."""
    out, left, rest = first.copy(), size.copy(), np.arange(len(size))
    while len(rest):  # 64 bytes at most a turn; few words are longer
        n, r = np.minimum(left[rest], 64), out[rest]
        out[rest] = functools.reduce(np.bitwise_xor, [_shifts()[n, k, (r >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)])
        left[rest] -= n
        rest = rest[left[rest] > 0]
    return out ^ second


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature's text and crc32, and each text's number of words."""
    data, offs = utf8(column)
    data = _LOWER[data]
    starts, ends = spans(data, offs, _WORD[data])
    words = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(words))
    one = run_crcs(data, starts, ends)
    same = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    blank = np.full(len(same), zlib.crc32(b" "), np.uint32)
    spaced = joined_crcs(one[same], blank, np.ones(len(same), np.int64))
    two = joined_crcs(spaced, one[same + 1], (ends - starts)[same + 1])
    return np.concatenate([doc, doc[same]]), np.concatenate([one, two]), np.diff(words)


def _postings(df: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            doc, crc, words = features(b.column("text"))
            n = pa.array(np.maximum(2 * words - 1, 0), pa.int64())
            facts = pa.RecordBatch.from_arrays([b.column("id"), n, pa.array(words, pa.int64())], ["id", "n_features", "n_words"])
            yield slice_rows(facts, pack(doc, (crc % np.uint32(buckets)).astype(np.int64), b.num_rows, RANGES))

    return df.mapInArrow(lean(run), KIND)


def importance_weights(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, scratch: list[str] | None = None) -> DataFrame:
    """One row per input row: id, n_features, n_words, weight. The target's ids are not read."""
    scratch = [] if scratch is None else scratch
    own = _postings(keyed(df, id_col, text_col), buckets).withColumn("side", F.lit(False))
    others = _postings(target.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), buckets).withColumn("side", F.lit(True))
    rows = stored(own.union(others), "postings", scratch)
    sums = stored(totals(rows, "side"), "totals", scratch)

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body"):
                _, s, t = opened(body.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([int(s.sum())]), pa.array([int(t.sum())])], ["s", "t"])

    all_s, all_t = (x or 0 for x in sums.mapInArrow(size, "s long, t long").agg(F.sum("s"), F.sum("t")).first())

    def gain(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.array([[np.floor(1000 * log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))] for s, t in counts.tolist()], np.int64).reshape(-1, 1)

    mine = rows.where("NOT side").drop("side")
    out = gathered(mine, answered(mine, sums, gain, RANGES), "id long, n_features long, n_words long", ["gains"])
    weight = F.when(F.col("n_features") > 0, F.expr("gains div n_features") - (F.expr("gains % n_features") < 0).cast("long")).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_features", "n_words", weight.alias("weight"))


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, share: int = 25, shortest: int = 20, seed: int = 7) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (null: not drawn), n_words."""
    scratch: list[str] = []
    rows = importance_weights(df, target, id_col, text_col, buckets, scratch)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    cleared(df.sparkSession, scratch)
    # scores are whole and lie within some 10**5 values: their counts, summed from the top by blocks, give every score its first rank
    counts = rows.where((F.col("n_words") >= shortest) & F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("block", F.expr("score div 1024")), "counts")
    drawn = (counts.agg(F.sum("n")).first()[0] or 0) * share // 100
    before = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.join(blocks, "block").select(F.col("score").alias("score_"), (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above"))
    first = stored(first.where(F.col("above") < drawn), "first")
    same = [id_col, "n_features", "n_words", "weight", "score"]
    high = F.coalesce((F.col("n_words") >= shortest) & F.col("score").isNotNull(), F.lit(False))
    found = rows.withColumn("chunk", F.expr("monotonically_increasing_id() div 65536")).where(high).join(F.broadcast(first), F.col("score") == F.col("score_"), "left")
    # equal rows are counted, some at a time, before they travel
    able = found.where("above IS NOT NULL").groupBy(*same, "above", "chunk").agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(Window.partitionBy("score").orderBy(id_col, "n_features", "n_words", "weight", "chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = able.withColumn("last", F.col("above") + upto)
    taken = taken.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last")))).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    none = F.lit(None).cast("long")
    left, rest = found.where("above IS NULL").withColumn("rank", none), rows.where(~high).withColumn("rank", none)
    columns = [id_col, "n_features", "weight", "score", "rank", "n_words"]
    return taken.select(columns).union(left.select(columns)).union(rest.select(columns))
