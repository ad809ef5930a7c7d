"""Inverted postings over slices of documents: (key, document, count) lists dealt by key, answers summed by document.

A slice is some MB of whole texts. pack() turns its occurrences (document, key) into one row for each of `ranges` ranges of keys:
sorted keys, for each its documents and counts, compressed. These rows and one of facts about the slice's documents are written to
the shared folder, so slices keep their random names whatever task is lost. totals() adds the counts of each key over all
slices, at first inside each task. answered() brings a range's totals and its postings together: the totals come first in a sorted
partition and stay, the postings pass by one row at a time, so a task holds the keys of one range and one slice. Each range is cut
by slice into as many cells as the stored bytes ask for: a key that every document holds is spread over these, as
its postings are (documents count once in it, however often they hold it). gathered() adds the answers of all ranges to the facts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, streamed, task_keys

KIND = "slice long, part int, held long, body binary"
FACTS = -1
CELL_BYTES = 32 << 20


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, each in the narrowest type that holds it."""
    out = [np.array([len(columns)], np.int64)]
    for c in columns:
        kind = np.min_scalar_type(int(c.max())) if len(c) else np.dtype(np.uint8)
        out += [np.array([len(c), kind.itemsize], np.int64), c.astype(kind)]
    return zstandard.compress(b"".join(x.tobytes() for x in out), 1)


def opened(body: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        n, size = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(np.frombuffer(data, f"u{size}", n, at + 16).astype(np.int64))
        at += 16 + n * size
    return out


def pack(doc: np.ndarray, key: np.ndarray, n_docs: int, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, postings, body) for each range of a slice that has occurrences; keys are under 2**31, a range is key % ranges."""
    code = ((key % ranges) << 31 | key // ranges) * n_docs + doc
    code, n = np.unique(code, return_counts=True)
    code, doc = code // max(n_docs, 1), code % max(n_docs, 1)
    cuts = np.searchsorted(code >> 31, np.arange(ranges + 1))
    for r in range(ranges):
        if cuts[r + 1] > cuts[r]:
            mine = slice(cuts[r], cuts[r + 1])
            keys, runs = np.unique(code[mine] & 0x7FFFFFFF, return_counts=True)
            yield r, int(cuts[r + 1] - cuts[r]), squeezed(np.diff(keys, prepend=0), runs, doc[mine], n[mine])


def slice_rows(facts: pa.RecordBatch, packed: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """The rows of one slice: the facts of its documents, an Arrow batch, and its postings."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, facts.schema) as w:
        w.write_batch(facts)
    rows = [(FACTS, facts.num_rows, zstandard.compress(sink.getvalue().to_pybytes(), 1)), *packed]
    name = int.from_bytes(os.urandom(8), "big") >> 1
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True))], ["slice", "part", "held", "body"])


def merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (rows of columns) by distinct key."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros((len(found), sums[0].shape[1]), np.int64)
    np.add.at(out, at, np.concatenate(sums))
    return found, out


class _Sums:
    """Running sums by key: what waits is merged when it outgrows what is there."""

    def __init__(self) -> None:
        self.keys, self.sums, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.waiting += len(keys)
        if self.waiting > max(1 << 20, 2 * len(self.keys[0])):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = merged(self.keys, self.sums)
        self.keys, self.sums, self.waiting = [keys], [sums], 0
        return keys, sums


def totals(postings: DataFrame, column: str | None = None) -> DataFrame:
    """(part, body) of each range: its keys and their counts over all slices.

    column: a boolean column of the rows; then there are two counts, of rows where it is false and where it is true.
    """
    wide = 2 if column else 1

    def taken(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(b.num_rows):
            gaps, *rest = opened(b.column("body")[k].as_py())
            if name == "sums":
                yield b.column("part")[k].as_py(), np.cumsum(gaps), np.stack(rest, 1)
            else:
                runs, _, n = rest
                sums = np.zeros((len(runs), wide), np.int64)
                sums[:, int(b.column("side")[k].as_py())] = np.add.reduceat(n, np.cumsum(runs) - runs)
                yield b.column("part")[k].as_py(), np.cumsum(gaps), sums

    def row(part: int, held: _Sums) -> pa.RecordBatch:
        keys, sums = held.close()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeezed(np.diff(keys, prepend=0), *sums.T)], pa.binary())], ["part", "body"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Sums] = {}
        for b in batches:
            for part, keys, sums in taken(b, "postings"):
                held.setdefault(part, _Sums()).add(keys, sums)
            if sum(len(s.keys[0]) + s.waiting for s in held.values()) > 1 << 23:  # a task holds some 100 MB of them
                yield from (row(part, s) for part, s in held.items())
                held.clear()
        yield from (row(part, s) for part, s in held.items())

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, _Sums()
        for b in batches:
            for part, keys, sums in taken(b, "sums"):
                if part != last and last is not None:
                    yield row(last, held)
                    held = _Sums()
                last = part
                held.add(keys, sums)
        if last is not None:
            yield row(last, held)

    side = F.col(column) if column else F.lit(False)
    rows = postings.where(f"part <> {FACTS}").select("part", "body", side.alias("side")).mapInArrow(lean(inside), "part int, body binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lean(across), "part int, body binary")


def answered(postings: DataFrame, sums: DataFrame, value: Callable[[np.ndarray, np.ndarray], np.ndarray], ranges: int) -> DataFrame:
    """(slice, body): for each document of a slice the sums, over its postings in one range, of count times value.

    value(keys, counts) -> one row of int64 columns a key. sums: what totals() gave, stored.
    """
    spark = postings.sparkSession
    size = postings.where(f"part <> {FACTS}").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = max(1, -(-size // (ranges * CELL_BYTES)))
    places = task_keys(spark, ranges * cells)
    place = F.element_at(F.array(*map(F.lit, places.tolist())), F.col("part") * cells + F.col("cell") + 1) if len(places) <= 4096 else F.col("part") * cells + F.col("cell")
    kept = sums.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select("part", "cell", F.lit(None).cast("long").alias("slice"), "body")
    asked = postings.where(f"part <> {FACTS}").select("part", F.pmod(F.xxhash64("slice"), F.lit(cells)).cast("int").alias("cell"), "slice", "body")
    dealt = kept.union(asked).withColumn("place", place).repartition(ranges * cells, "place").sortWithinPartitions("place", F.col("slice").asc_nulls_first())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        for b in batches:
            for part, name, body in zip(b.column("part").to_pylist(), b.column("slice").to_pylist(), b.column("body"), strict=True):
                gaps, *rest = opened(body.as_py())
                if name is None:
                    keys = np.cumsum(gaps)
                    values = value(keys * ranges + part, np.stack(rest, 1))
                    continue
                runs, doc, n = rest
                own = np.repeat(values[np.searchsorted(keys, np.cumsum(gaps))], runs, axis=0) * n[:, None]
                docs, at = np.unique(doc, return_inverse=True)
                out = np.zeros((len(docs), own.shape[1]), np.int64)
                np.add.at(out, at, own)
                body = zstandard.compress(np.concatenate([np.array([len(docs)]), docs, out.ravel()]).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body], pa.binary())], ["slice", "body"])

    return dealt.mapInArrow(lean(weigh), "slice long, body binary")


def gathered(postings: DataFrame, answers: DataFrame, facts: str, columns: list[str]) -> DataFrame:
    """One row per document: the facts and the sums of its answers over all ranges, 0 where it has no posting."""

    def add(t: pa.Table) -> pa.RecordBatch:
        own, sums = None, []
        for known, body in zip(t.column("facts").to_pylist(), t.column("body").to_pylist(), strict=True):
            data = zstandard.decompress(body)
            if known:
                own = pa.ipc.open_stream(data).read_next_batch()
            else:
                sums.append(np.frombuffer(data, np.int64))
        out = np.zeros((own.num_rows, len(columns)), np.int64)
        for x in sums:
            docs = x[1 : 1 + x[0]]
            out[docs] += x[1 + x[0] :].reshape(len(docs), len(columns))
        return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(columns)))], [*own.schema.names, *columns])

    rows = answers.select("slice", F.lit(False).alias("facts"), "body").union(postings.where(f"part = {FACTS}").select("slice", F.lit(True), "body"))
    return streamed(rows, ["slice"], add, ", ".join([facts, *(f"{c} long" for c in columns)]))
