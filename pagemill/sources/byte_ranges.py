"""UTF-8 diagnostics of files of any size, by byte ranges in parallel.

A byte that is no continuation byte always starts a unit: a character, or the longest ill-formed part that a decoder replaces
as one. So the units that start in a range are found from the three bytes before it and the three after it; each range
decodes its own, whole, and the files' answers are sums and minima of the ranges'.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyarrow import fs

from pagemill.sources.files import _store

FORMAT = "pagemill_utf8_ranges"
SCHEMA = "path string, n_bytes long, n_replacement long, n_chars long, error_start long, error_end long, error_hex string, error_reason string"
_MARGIN = 4


@dataclass
class Ranges(InputPartition):
    pieces: list[tuple[str, int, int, int]]  # path, size of the file, first byte, end


def _unit(data: bytes) -> int:
    """Bytes of the unit at the start of data."""
    try:
        return len(data[:_MARGIN].decode()[0].encode())
    except UnicodeDecodeError as e:
        return len(data[: e.start].decode()[0].encode()) if e.start else e.end


def _boundary(data: bytes, at: int) -> int:
    """The end of the unit that holds the byte before `at`, or `at` where that unit ends sooner."""
    for k in range(at - 1, max(at - _MARGIN, -1), -1):
        if data[k] & 0xC0 != 0x80:
            return max(at, k + _unit(data[k : k + _MARGIN]))
    return at


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width, self.pattern = options["path"], int(options["width"]), options["pattern"]

    def partitions(self) -> list[Ranges]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, room = [], 0
        for f in sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            for start in range(0, max(f.size, 1), self.width):
                end = min(start + self.width, f.size)
                if not out or end - start > room or len(out[-1].pieces) >= 1000:  # small files share a task
                    out.append(Ranges([]))
                    room = self.width
                out[-1].pieces.append((f.path, f.size, start, end))
                room -= end - start
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, size, start, end in partition.pieces:
            low = max(start - _MARGIN, 0)
            with store.open_input_file(path) as f:
                data = f.read_at(min(end + _MARGIN, size) - low, low)
            first, last = _boundary(data, start - low), _boundary(data, end - low)
            text, error = data[first:last].decode(errors="replace"), (None, None, None, None)
            try:
                data[first:].decode()
            except UnicodeDecodeError as e:
                if first + e.start < last:
                    at = low + first
                    error = (at + e.start, at + e.end, e.object[e.start : e.end].hex(), e.reason)
            yield (path, size, text.count("�"), len(text), *error)


class Utf8Ranges(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def utf8_by_ranges(spark: SparkSession, path: str, width: int = 16 << 20, pattern: str = "*") -> DataFrame:
    """For each file its bytes, strict validity, first error, replacement characters and characters after a lossy decode.

    path: a file or a folder, read to the bottom, in any store that pyarrow knows by its address. No task holds more than `width`
    bytes at once. An empty file is valid and has no characters.
    """
    spark.dataSource.register(Utf8Ranges)
    parts = spark.read.format(FORMAT).option("width", width).option("pattern", pattern).load(path)
    error = F.struct("error_start", "error_end", "error_hex", "error_reason")
    return parts.groupBy("path", "n_bytes").agg(
        (F.count("error_start") == 0).alias("valid"),
        F.min_by(error, "error_start").alias("error"),
        F.sum("n_replacement").alias("n_replacement"),
        F.sum("n_chars").alias("n_chars"),
    )
