"""Region matching by overlap and what went wrong on a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.geometry import box, coverage
from pagemill.operators.pages import BOX, SMALL, boxes, by_pages, ious, ranks


def overlapping_pairs(ref: DataFrame, pred: DataFrame, page: str = "page_id", region: str = "region_id") -> DataFrame:
    """Pairs of boxes of one page that touch: an equi join on page and grid cell, each pair once.

    Cells of 256 pixels keep the candidates of a crowded page near each other instead of pairing all its boxes.
    """
    cell = 256

    def cells(df: DataFrame, side: str) -> DataFrame:
        c = df.select(F.col(page).alias("page"), F.col(region).alias(f"{side}_id"), box(*BOX).alias(side))
        span = lambda a, b: F.sequence(F.floor(F.col(f"{side}.{a}") / cell), F.floor((F.greatest(F.col(f"{side}.{b}"), F.col(f"{side}.{a}") + 1) - 1) / cell))
        return c.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))

    a, b = cells(ref, "ref"), cells(pred, "pred")
    first = (F.floor(F.greatest("ref.x1", "pred.x1") / cell) == F.col("cx")) & (F.floor(F.greatest("ref.y1", "pred.y1") / cell) == F.col("cy"))
    meet = (F.least("ref.x2", "pred.x2") > F.greatest("ref.x1", "pred.x1")) & (F.least("ref.y2", "pred.y2") > F.greatest("ref.y1", "pred.y1"))
    return a.join(b, ["page", "cx", "cy"]).where(first & meet).drop("cx", "cy")


def match_regions(ref: DataFrame, pred: DataFrame, page: str = "page_id", region: str = "region_id", least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches: references in order of id take the unused prediction of highest IoU, the earliest of equals."""
    kind = dict(ref.dtypes)[region]
    both = ref.select(page, region, *BOX, F.lit(0).alias("side")).unionByName(pred.select(page, region, *BOX, F.lit(1).alias("side")))

    def fold(t: pa.Table, starts: np.ndarray) -> dict:
        rows, other, share = greedy_pairs(boxes(t), ranks(t.column(region)), np.asarray(t.column("side")), starts, least)
        own = t.column(region)
        return {page: t.column(page).take(pa.array(rows)), "ref_id": own.take(pa.array(rows)), "pred_id": own.take(pa.array(other)), "iou": pa.array(share, pa.float64())}

    return by_pages(both, page, fold, f"`{page}` {dict(ref.dtypes)[page]}, ref_id {kind}, pred_id {kind}, iou double", [page, "ref_id", "pred_id", "iou"])


def greedy_pairs(b: np.ndarray, ids: np.ndarray, side: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(row of the reference, row of the prediction, IoU) of the matches of many pages. The n-th references of all small pages go together."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(b)]))
    order = np.lexsort((ids, side, of))
    n_ref, n_pred = (np.bincount(of[side == s], minlength=len(starts)) for s in (0, 1))
    found = []
    for p in np.flatnonzero((n_pred > SMALL) & (n_ref > 0)):
        refs, preds = np.split(order[starts[p] : starts[p] + n_ref[p] + n_pred[p]], [n_ref[p]])
        free = np.ones(len(preds), bool)
        for k in refs:
            v = np.where(free, ious(b[k], b[preds]), -1)
            best = int(v.argmax())
            if v[best] >= least:
                free[best] = False
                found.append((np.array([k]), preds[[best]], v[[best]]))
    small = np.flatnonzero((n_pred <= SMALL) & (n_pred > 0) & (n_ref > 0))
    small = small[np.argsort(-n_ref[small], kind="stable")]  # pages that still have references are the first ones
    if len(small):
        slot = np.arange(n_pred[small].max())
        free = slot < n_pred[small][:, None]
        preds = order[np.where(free, (starts + n_ref)[small][:, None] + slot, 0)]
        other = b[preds]
        for r in range(n_ref[small[0]]):
            on = int(np.searchsorted(-n_ref[small], -r, side="left"))
            rows, some = order[starts[small[:on]] + r], np.arange(on)
            v = np.where(free[:on], ious(b[rows].T[:, :, None], other[:on]), -1)
            best = v.argmax(1)
            hit = v[some, best] >= least
            some, best = some[hit], best[hit]
            free[some, best] = False
            found.append((rows[hit], preds[some, best], v[some, best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def split_merge(ref: DataFrame, pred: DataFrame, page: str = "page_id", region: str = "region_id", least: float = 0.35) -> DataFrame:
    """References covered by several predictions and predictions that cover several references; coverage is of the reference."""
    pairs = overlapping_pairs(ref, pred, page, region).where(coverage(F.col("ref"), F.col("pred")) >= least)
    split = pairs.groupBy(F.col("page"), F.col("ref_id").alias("region_id")).agg(F.count("*").alias("overlap_count")).where("overlap_count > 1")
    merge = pairs.groupBy(F.col("page"), F.col("pred_id").alias("region_id")).agg(F.count("*").alias("overlap_count")).where("overlap_count > 1")
    what = lambda df, kind: df.select(F.col("page").alias(page), F.lit(kind).alias("reason"), "region_id", "overlap_count")
    return what(split, "reference_region_split_across_predictions").unionByName(what(merge, "predicted_region_merges_references"))


#: Pairs of boxes that are held against each other at once, wider pages by themselves.
PAIRS = 1 << 20


def cover_counts(b: np.ndarray, sides: np.ndarray, of: np.ndarray, order: np.ndarray, n_pages: int, least: float) -> np.ndarray:
    """For each row how many of its page's other side it covers or is covered by; coverage is of the reference. order: by page and side."""
    n_ref, n_pred = (np.bincount(of[sides == s], minlength=n_pages) for s in (0, 1))
    starts = np.r_[0, np.cumsum(n_ref + n_pred)[:-1]]
    size = np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    size, out = np.where(size > 0, size, np.inf), np.zeros(len(b), np.int64)
    area, lo = np.cumsum(n_ref * n_pred), 0
    while lo < n_pages:
        hi = max(lo + 1, int(np.searchsorted(area, (area[lo - 1] if lo else 0) + PAIRS, side="right")))
        here = (n_ref * n_pred)[lo:hi]
        p = np.repeat(np.arange(lo, hi), here)
        x, y = np.divmod(np.arange(len(p)) - np.repeat(np.cumsum(here) - here, here), n_pred[p])
        r, q = order[starts[p] + x], order[(starts + n_ref)[p] + y]
        w = np.minimum(b[r, 2], b[q, 2]) - np.maximum(b[r, 0], b[q, 0])
        h = np.minimum(b[r, 3], b[q, 3]) - np.maximum(b[r, 1], b[q, 1])
        on = np.maximum(w, 0) * np.maximum(h, 0) / size[r] >= least
        out += np.bincount(r[on], minlength=len(b)) + np.bincount(q[on], minlength=len(b))
        lo = hi
    return out


def attribute_failures(ref: DataFrame, pred: DataFrame, page: str = "page_id", region: str = "region_id", least_iou: float = 0.5, least_coverage: float = 0.35) -> DataFrame:
    """All failures of all pages: page, failure_type, region_id, matched_region_id, iou, details. One shuffle, no join.

    Both sides carry text and reading_index; best_text, the chosen hypothesis, counts instead of text where it is there. On a
    page: split references, merging predictions, then each reference's own failures, then unmatched predictions.
    """
    kind, page_kind = dict(ref.dtypes)[region], dict(ref.dtypes)[page]

    def side(df: DataFrame, n: int) -> DataFrame:
        best = F.coalesce("best_text", "text") if "best_text" in df.columns else F.col("text")
        return df.select(page, region, *BOX, F.col("text").cast("string").alias("text"), best.cast("string").alias("best"), F.col("reading_index").cast("long").alias("place"), F.lit(n).alias("side"))

    def fold(t: pa.Table, starts: np.ndarray) -> dict:
        b, ids, sides, own = boxes(t), ranks(t.column(region)), np.asarray(t.column("side")), t.column(region)
        text, best, place = (t.column(c).combine_chunks() for c in ("text", "best", "place"))
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(b)]))
        covered = cover_counts(b, sides, of, np.lexsort((ids, sides, of)), len(starts), least_coverage)
        ref, pred, share = greedy_pairs(b, ids, sides, starts, least_iou)
        alone = np.ones(len(b), bool)
        alone[ref], alone[pred] = False, False
        none, found = np.zeros(0, np.int64), []

        def add(section: int, kind: str, one: np.ndarray, two: np.ndarray, iou: np.ndarray | None, **details: pa.Array | str) -> None:
            n = max(len(one), len(two))
            values = pa.concat_arrays([pa.array([v] * n, pa.string()) if isinstance(v, str) else v for v in details.values()])
            values = values.take(pa.array(np.arange(n * len(details)).reshape(len(details), n).T.reshape(-1)))
            pairs = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(details)), pa.array(list(details) * n, pa.string()), values)
            side = [own.take(pa.array(x)).combine_chunks() if len(x) else pa.nulls(n, own.type) for x in (one, two)]
            found.append((one if len(one) else two, np.full(n, section), pa.array([kind] * n, pa.string()), *side, pa.nulls(n, pa.float64()) if iou is None else pa.array(iou, pa.float64()), pairs))

        counted = lambda rows: pc.cast(pa.array(covered[rows]), pa.string())
        differ = lambda x, y: np.asarray(pc.fill_null(pc.not_equal(x, y), False)) | (np.asarray(pc.is_null(x)) != np.asarray(pc.is_null(y)))
        at = lambda column, rows: column.take(pa.array(rows))
        number = lambda rows: pc.fill_null(pc.cast(at(place, rows), pa.string()), "None")
        k = np.flatnonzero((covered > 1) & (sides == 0))
        add(0, "split_merge_failure", k, none, None, reason="reference_region_split_across_predictions", overlap_count=counted(k))
        k = np.flatnonzero((covered > 1) & (sides == 1))
        add(1, "split_merge_failure", none, k, None, reason="predicted_region_merges_references", overlap_count=counted(k))
        add(2, "detection_failure", np.flatnonzero(alone & (sides == 0)), none, None, reason="reference_region_unmatched")
        on = differ(at(place, ref), at(place, pred))
        add(2, "ordering_failure", ref[on], pred[on], share[on], reference_order=number(ref[on]), predicted_order=number(pred[on]))
        on = differ(at(best, ref), at(best, pred))
        add(2, "ocr_failure", ref[on], pred[on], share[on], reason="matched_region_text_mismatch", reference_text=at(best, ref[on]), predicted_text=at(best, pred[on]))
        on = differ(at(text, pred), at(best, pred)) & np.asarray(pc.fill_null(pc.not_equal(at(text, pred), ""), False))
        add(2, "postprocess_failure", ref[on], pred[on], share[on], reason="stored_text_differs_from_selected_hypothesis", stored_text=at(text, pred[on]), selected_text=at(best, pred[on]))
        add(3, "overlap_duplicate_failure", none, np.flatnonzero(alone & (sides == 1)), None, reason="predicted_region_unmatched")
        rows, section, *columns = zip(*found, strict=True)
        rows, section = np.concatenate(rows), np.concatenate(section)
        order = np.lexsort((np.arange(len(rows)), ids[rows], section, of[rows]))
        made = dict(zip(names[1:], (pa.concat_arrays(c).take(pa.array(order)) for c in columns), strict=True))
        return {page: t.column(page).take(pa.array(rows[order])), **made}

    names = [page, "failure_type", "region_id", "matched_region_id", "iou", "details"]
    return by_pages(side(ref, 0).unionByName(side(pred, 1)), page, fold, f"`{page}` {page_kind}, failure_type string, region_id {kind}, matched_region_id {kind}, iou double, details map<string,string>", names)
