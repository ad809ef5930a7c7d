"""Shared pieces: tables in the shared folder, word hashing over Arrow buffers, grouped streams."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: A list of ids, some tens of bytes each, is broadcast up to so many rows and joined by sort and merge beyond.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session of one machine may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.conf.get("spark.master", None) or ""):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def stored(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    scratch: takes the path of a table that no result reads in the end, for cleared().
    """
    path = f"{shared_dir(df.sparkSession)}/pagemill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, scratch: list[str]) -> None:
    """Delete stored tables that are needed no more."""
    for path in scratch:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    scratch.clear()


def sized(table: DataFrame) -> DataFrame:
    """A stored, narrow table as the build side of a join: broadcast if its rows are few, else left to sort and merge."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text) as long and string: any other column, clashing names included, is left behind."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def remainder(col: str | F.Column, modulus: int) -> F.Column:
    """crc32 of the decimal id, modulo; a null id counts as remainder 0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and their n + 1 offsets."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n, buffers = len(column), column.buffers()
    offs = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = (np.full(size, r, np.uint64) for r in (_R, _R_INV))
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):  # in place: columns are long
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def spans(data: np.ndarray, offs: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inner holds; no run crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inner[:-1]
    starts = np.flatnonzero(inner & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inner[1:]
    ends = np.flatnonzero(inner & (~after | first[1:])) + 1
    return starts, ends


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, the same wherever the run stands."""
    up, down = _power(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ of all texts in order, and each text's first word, n + 1."""
    data, offs = utf8(column)
    hashes, firsts, n, at = [np.zeros(0, np.uint64)], [], 0, 0
    while at < len(offs) - 1:  # whole texts, about SLICE_BYTES at a time: the 64-bit columns over bytes stay small
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        part, own = _LOWER[data[offs[at] : offs[to]]], offs[at : to + 1] - offs[at]
        starts, ends = spans(part, own, ~_SPACE[part])
        hashes.append(run_hashes(part, starts, ends))
        firsts.append(np.searchsorted(starts, own[:-1]) + n)
        n, at = n + len(starts), to
    return np.concatenate(hashes), np.concatenate([*firsts, [n]]).astype(np.int64)


def task_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of `parts` partitions a key that repartition(parts, key) deals to it: keys by number would collide in some tasks."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(24 * parts + 200).groupBy(place.alias("p")).agg(F.min("id").alias("k")).toArrow()
    keys = np.arange(1 << 30, (1 << 30) + parts, dtype=np.int32)  # any distinct key will do where none was found
    keys[found.column("p").to_numpy()] = found.column("k").to_numpy()
    return keys


def trimmed() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, with its memory given back when a task ends: idle workers stay beside the JVM."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trimmed()

    return run


def streamed(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType | str, parts: int | None = None, once: bool = False) -> DataFrame:
    """fn over each group of equal keys, as a stream over sorted partitions: one Python start a task, one group in memory.

    once: rows that several groups of a task give are given once (as far as a million rows go back).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept and (out := fn(pa.Table.from_batches(kept))) is not None and out.num_rows:
                yield out
            kept.clear()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                key = tuple(c[lo] for c in cols)
                if key != last:
                    yield from flush()
                    last = key
                kept.append(b.slice(lo, hi - lo))
        yield from flush()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if sum(x.num_rows for x in held) > 1_000_000:
                t = pa.Table.from_batches(held).group_by(b.schema.names).aggregate([])
                held = t.combine_chunks().to_batches()
                if t.num_rows > 500_000:
                    yield from held
                    held = []
        if held:
            yield from pa.Table.from_batches(held).group_by(held[0].schema.names).aggregate([]).to_batches()

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(lean(distinct if once else run), schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (u, v): alternating large and small stars until the edge set stands still.

    Every step is a join and an aggregate; nothing but two sums comes to the driver. Nodes without an edge are absent.
    """
    spark, old, now = edges.sparkSession, [], []
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", now)
    # the least neighbours are stored before they are joined, so that the edges of a hub need not meet in one task
    least = lambda of, low: sized(stored(of.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", low), "least", old))
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = least(both, F.least("m", "w"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large", old)
        low = least(large, F.col("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old += now
        now.clear()
        e = stored(small.where("u <> v").distinct(), "edges", now)
        cleared(spark, old)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
