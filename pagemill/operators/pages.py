"""Ordered folds inside one page, the only place where a page's rows meet in Python.

A page's regions are a bounded set (an image holds hundreds). Pages are dealt by id, one Python start a task. Folds that most
queries wait for take the small pages of a batch together, a step of all pages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BOX = ["x1", "y1", "x2", "y2"]


def dealt(df: DataFrame, page: str) -> DataFrame:
    """Rows of a page together, over as many tasks as the session asks for: page work is heavy for its bytes, and
    partitions of a stated number are not merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), page)


def per_page(df: DataFrame, page: str, fn: Callable[[pa.Table], dict], schema: str, names: list[str]) -> DataFrame:
    """fn maps the columns of a page to columns of rows; columns that it does not give are those of the page."""

    def run(t: pa.Table) -> pa.Table:
        cols = fn(t)
        return pa.table({n: cols[n] if n in cols else t.column(n) for n in names})

    return dealt(df, page).groupBy(page).applyInArrow(run, schema)


#: Regions of a page up to which it is taken together with others.
SMALL = 64


def page_starts(t: pa.Table, page: str) -> np.ndarray:
    """Where each page begins in rows that are sorted by page."""
    c = t.column(page)
    if len(c) < 2:
        return np.arange(len(c))
    gone = np.asarray(pc.is_null(c))
    other = np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False)) | (gone[1:] != gone[:-1])
    return np.r_[0, np.flatnonzero(other) + 1]


def whole_pages(batches: Iterator[pa.RecordBatch], page: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of sorted rows as tables of whole pages with each page's start; the last page of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held:  # a page over many batches is put together once
            last, first = held[-1].column(page)[-1].as_py(), batch.column(page)
            if last == first[0].as_py() and last == first[-1].as_py():
                held.append(batch)
                continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = page_starts(t, page)
        if starts[-1]:
            yield t.slice(0, starts[-1]), starts[:-1]
        held = t.slice(starts[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, page_starts(t, page)


def by_pages(df: DataFrame, page: str, fn: Callable[[pa.Table, np.ndarray], dict], schema: str, names: list[str]) -> DataFrame:
    """As per_page, but fn gets rows of many whole pages, sorted by page, and each page's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_pages(batches, page):
            cols = fn(t, starts)
            yield from pa.table({n: cols[n] if n in cols else t.column(n) for n in names}).combine_chunks().to_batches()

    return dealt(df, page).sortWithinPartitions(page).mapInArrow(run, schema)


def ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Places of values in their order; equal ones share one."""
    return np.asarray(pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)


def boxes(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(np.float64) for c in BOX], 1).reshape(-1, 4)


def ious(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """one: four numbers, or four arrays that go with the boxes of many (last axis: a box)."""
    w = np.minimum(one[2], many[..., 2]) - np.maximum(one[0], many[..., 0])
    h = np.minimum(one[3], many[..., 3]) - np.maximum(one[1], many[..., 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x1, y1, x2, y2: np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    total = size(*one) + size(*np.moveaxis(many, -1, 0)) - both
    return np.where(both > 0, both / np.where(total > 0, total, 1), 0.0)
