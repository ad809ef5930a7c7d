"""Reading order from geometry: duplicate suppression, line clusters, page text.

Lines are clusters around an anchor: in order of (y1, x1, x2, id) a region joins the first line whose anchor's centre lies
within tolerance times the greater of both heights, else it opens a line of its own. An anchor's geometry never changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.hashing import box_text, stable_id
from pagemill.operators.pages import BOX, SMALL, boxes, by_pages, dealt, ious, per_page, ranks

#: Regions whose text is no part of a page's text.
NON_TEXT_TYPES = ("image", "graph")


def text_evaluable(region_type: Column, language: Column, legibility: Column, wanted: str = "uk") -> Column:
    """A null language or legibility passes; the crop filter, in contrast, excludes it."""
    return ~region_type.isin(*NON_TEXT_TYPES) & (language.isNull() | (language == wanted)) & (legibility.isNull() | (legibility == "legible"))


def suppress_duplicates(df: DataFrame, page: str = "page_id", region: str = "region_id", text: str | None = "text", threshold: float = 0.95) -> DataFrame:
    """Every region with duplicate_of: the first kept region, in order (y1, x1, id), that it repeats, or null for a kept one.

    A region is compared with kept regions only, so the end of a chain of near duplicates may stay. With text=None equal
    text is not asked for.
    """
    pick = [page, region, "x1", "y1", "x2", "y2", *([text] if text else [])]

    def fold(t: pa.Table) -> dict:
        b, ids = boxes(t), t.column(region).to_pylist()
        texts = t.column(text).to_pylist() if text else [None] * len(ids)
        order = sorted(range(len(ids)), key=lambda k: (b[k, 1], b[k, 0], ids[k]))
        kept, of, share = [], [None] * len(ids), [None] * len(ids)
        for k in order:
            at = np.array(kept, int)
            v = ious(b[k], b[at]) if kept else np.zeros(0)
            same = next((j for j in np.flatnonzero(v >= threshold) if texts[at[j]] == texts[k]), None)
            if same is None:
                kept.append(k)
            else:
                of[k], share[k] = ids[at[same]], float(v[same])
        kind = t.schema.field(region).type
        return {page: t.column(page), region: t.column(region), "duplicate_of": pa.array(of, kind), "duplicate_iou": pa.array(share, pa.float64())}

    kinds = dict(df.dtypes)
    schema = f"`{page}` {kinds[page]}, `{region}` {kinds[region]}, duplicate_of {kinds[region]}, duplicate_iou double"
    return per_page(df.select(*pick), page, fold, schema, [page, region, "duplicate_of", "duplicate_iou"])


def order_regions(df: DataFrame, page: str = "page_id", region: str = "region_id", tolerance: float = 0.5) -> DataFrame:
    """The rows of df with line_index, within_line_index and reading_index, all from 0; every column is carried through."""

    def fold(t: pa.Table, starts: np.ndarray) -> dict:
        line, read, of = _lines_of_pages(t, region, starts, tolerance)
        fresh = np.flatnonzero(np.r_[True, (np.diff(of[read]) != 0) | (np.diff(line[read]) != 0)][: len(read)])
        place, within, at = np.empty(len(line), np.int32), np.empty(len(line), np.int32), np.arange(len(line))
        place[read] = at - starts[of[read]]
        within[read] = at - np.repeat(fresh, np.diff(np.r_[fresh, len(read)]))
        return {"line_index": pa.array(line.astype(np.int32)), "within_line_index": pa.array(within), "reading_index": pa.array(place)}

    made = ["line_index", "within_line_index", "reading_index"]
    rows = df.drop(*made)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + "".join(f", {c} int" for c in made)
    return by_pages(rows, page, fold, schema, [*rows.columns, *made])


def assembled_texts(df: DataFrame, texts: dict[str, str], evaluable: Column, carried: tuple[str, ...] = (), page: str = "page_id", region: str = "region_id", tolerance: float = 0.5) -> DataFrame:
    """One row a page: for each (name, column) of `texts` the page's text in reading order, and the first value of carried columns.

    Order and texts come from one fold, so the rows are shuffled once, whatever the number of texts. Regions that do not count
    and empty texts are left out after ordering.
    """
    names, ok = list(texts), "__counts"
    rows = df.select(page, region, *BOX, *carried, *(F.col(c).alias(f"__{n}") for n, c in texts.items()), F.coalesce(evaluable, F.lit(False)).alias(ok))

    def fold(t: pa.Table, starts: np.ndarray) -> dict:
        _, read, of = _lines_of_pages(t, region, starts, tolerance)
        read = read[np.asarray(t.column(ok))[read]]
        cuts = np.searchsorted(of[read], np.arange(len(starts) + 1)).tolist()
        first = {c: t.column(c).take(pa.array(starts)) for c in (page, *carried)}
        for n in names:
            texts = t.column(f"__{n}").take(pa.array(read)).to_pylist()
            first[n] = pa.array(["\n".join(filter(None, texts[lo:hi])) for lo, hi in zip(cuts, cuts[1:])], pa.string())
        return first

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (page, *carried)), *(f"`{n}` string" for n in names)])
    return by_pages(rows, page, fold, schema, [page, *carried, *names])


def _lines_of_pages(t: pa.Table, region: str, starts: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line of each row, all rows in reading order page by page, and each row's page. Small pages go together, a region of each at a time."""
    b, ids, sizes = boxes(t), ranks(t.column(region)), np.diff(np.r_[starts, t.num_rows])
    of = np.repeat(np.arange(len(starts)), sizes)
    line = np.zeros(len(b), np.int64)
    for p in np.flatnonzero(sizes > SMALL):
        here = slice(starts[p], starts[p] + sizes[p])
        line[here] = _lines(b[here], ids[here].tolist(), tolerance)[0]
    small = np.flatnonzero(sizes <= SMALL)
    small = small[np.argsort(-sizes[small], kind="stable")]  # pages that still have regions are the first ones
    if len(small):
        order = np.lexsort((ids, b[:, 2], b[:, 0], b[:, 1], of))
        centre, high = (b[:, 1] + b[:, 3]) / 2, np.maximum(b[:, 3] - b[:, 1], 1)
        anchors, tall, n = np.full((SMALL, len(small)), np.nan), np.zeros((SMALL, len(small))), np.zeros(len(small), np.int64)
        for r in range(sizes[small[0]]):
            on = int(np.searchsorted(-sizes[small], -r, side="left"))
            rows, some = order[starts[small[:on]] + r], np.arange(on)
            c, h, most = centre[rows], high[rows], max(1, int(n.max()))
            near = np.abs(anchors[:most, :on] - c) <= tolerance * np.maximum(tall[:most, :on], h)
            at = np.where(near.any(0), near.argmax(0), n[:on])
            new = at == n[:on]
            anchors[at[new], some[new]], tall[at[new], some[new]] = c[new], h[new]
            n[:on] += new
            line[rows] = at
    return line, np.lexsort((ids, b[:, 2], b[:, 1], b[:, 0], line, of)), of


def _lines(b: np.ndarray, ids: list, tolerance: float) -> tuple[np.ndarray, list[int]]:
    """Line of each region of a page, and all regions in reading order."""
    centre, high = (b[:, 1] + b[:, 3]) / 2, np.maximum(b[:, 3] - b[:, 1], 1)
    order = sorted(range(len(ids)), key=lambda k: (b[k, 1], b[k, 0], b[k, 2], ids[k]))
    anchors, line = np.zeros((len(ids), 2)), np.zeros(len(ids), np.int64)
    n = 0
    for k in order:
        near = np.abs(anchors[:n, 0] - centre[k]) <= tolerance * np.maximum(anchors[:n, 1], high[k])
        at = int(near.argmax()) if n and near.any() else n
        if at == n:
            anchors[n] = centre[k], high[k]
            n += 1
        line[k] = at
    return line, sorted(range(len(ids)), key=lambda k: (line[k], b[k, 0], b[k, 1], b[k, 2], ids[k]))


def ordered_pages(df: DataFrame, page: str = "page_id", region: str = "region_id", text: str = "text", threshold: float = 0.95, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Duplicates suppressed, then lines and numbers: (kept regions in order with line_id, one row of diagnostics a page)."""
    judged = suppress_duplicates(df, page, region, text, threshold)
    same = [F.col(c) == F.col(f"{c}_") for c in (page, region)]
    gone = judged.select(F.col(page).alias(f"{page}_"), F.col(region).alias(f"{region}_"), "duplicate_of")
    marked = df.join(gone, same[0] & same[1]).drop(f"{page}_", f"{region}_")
    kept = order_regions(marked.where("duplicate_of IS NULL").drop("duplicate_of"), page, region, tolerance)
    own = Window.partitionBy(page, "line_index")
    around = F.struct(*(f(c).over(own).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))
    kept = kept.withColumn("line_id", stable_id("line", F.col(page), F.col("line_index"), box_text(around)))
    event = lambda kind, one, of: F.struct(F.lit(kind).alias("event"), one.cast("string").alias("region"), of.cast("string").alias("of"))
    repeats = F.sort_array(F.collect_list(F.when(F.col("duplicate_of").isNotNull(), event("duplicate_suppressed", F.col(region), F.col("duplicate_of")))))
    counts = judged.groupBy(page).agg(F.count("*").alias("input_regions"), F.count("duplicate_of").alias("suppressed_duplicates"), repeats.alias("repeats"))
    per_line = kept.groupBy(page, "line_index", "line_id").agg(F.count("*").alias("n"))
    grouped = F.sort_array(F.collect_list(F.when(F.col("n") > 1, event("regions_grouped", F.col("line_id"), F.col("n")))))
    n_lines = per_line.groupBy(F.col(page).alias(f"{page}_")).agg(F.count("*").alias("line_count"), grouped.alias("grouped"))
    told = counts.join(n_lines, F.col(page) == F.col(f"{page}_"), "left").drop(f"{page}_")
    none = F.array().cast("array<struct<event:string,region:string,of:string>>")
    return kept, told.select(page, "input_regions", "suppressed_duplicates", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.concat(F.coalesce("repeats", none), F.coalesce("grouped", none)).alias("events"))


def lines(ordered: DataFrame, page: str = "page_id", region: str = "region_id", text: str = "text") -> DataFrame:
    """One row for each line of regions that carry line_index: box, region ids and text in order, empty texts left out."""
    inside = F.array_sort(F.collect_list(F.struct("within_line_index", F.col(region).alias("region"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    return ordered.groupBy(page, "line_index").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.transform(inside, lambda r: r.region).alias("region_ids"),
        F.array_join(F.filter(F.transform(inside, lambda r: r.text), lambda v: v != ""), "\n").alias("text"),
        F.count("*").alias("n_regions"),
    ).withColumn("line_id", line_id(page))


def line_id(page: str = "page_id") -> Column:
    """A stable name from page, line_index and the line's box x1 .. y2."""
    return stable_id("line", F.col(page), F.col("line_index"), box_text(F.struct(*BOX)))


def page_texts(ordered: DataFrame, evaluable: Column, page: str = "page_id", text: str = "text") -> DataFrame:
    """Text of each page: all regions are ordered first, then those that count and are not empty are joined by line ends."""
    kept = F.collect_list(F.when(evaluable & (F.col(text) != ""), F.struct("reading_index", F.col(text).alias("text"))))
    return dealt(ordered, page).groupBy(page).agg(F.array_join(F.transform(F.array_sort(kept), lambda r: r.text), "\n").alias("page_text"))
