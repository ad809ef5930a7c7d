"""Folds inside a page against plain loops on random pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import matching as M
from pagemill.operators import reading_order as R
from pagemill.operators.scoring import evaluate_pages
from pagemill.plans.builders import composite_score, detection_scores, page_baseline

SCHEMA = "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long, text string, region_type string, language string, legibility string"


def pages(spark, seed, n_pages=40, wide=60):
    rng, rows = random.Random(seed), []
    for p in range(n_pages):
        for k in range(rng.randrange(1, 15)):
            x, y = rng.randrange(wide), rng.randrange(wide)
            rows.append((p, k, x, y, x + rng.randrange(1, 25), y + rng.randrange(1, 25), rng.choice(["a", "b", ""]), rng.choice(["printed", "image"]), rng.choice(["uk", None, "de"]), rng.choice(["legible", None])))
    return rows, spark.createDataFrame(rows, SCHEMA)


def share(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(w, 0) * max(h, 0)
    return both / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - both)


def test_reading_order(spark):
    rows, df = pages(spark, 1)
    want = {}
    for p in {r[0] for r in rows}:
        rest, line, n = sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[2], r[4], r[1])), 0, 0
        while rest:
            a = rest[0]
            near = [r for r in rest if abs((r[3] + r[5]) / 2 - (a[3] + a[5]) / 2) <= 0.5 * max(a[5] - a[3], r[5] - r[3])]
            rest = [r for r in rest if r not in near]
            for k, r in enumerate(sorted(near, key=lambda r: (r[2], r[3], r[4], r[1]))):
                want[p, r[1]] = (line, k, n)
                n += 1
            line += 1
    got = {(r.page_id, r.region_id): (r.line_index, r.within_line_index, r.reading_index) for r in R.order_regions(df).collect()}
    assert got == want
    joined = R.lines(R.order_regions(df)).collect()
    assert sum(r.n_regions for r in joined) == len(rows)


def test_anchor_does_not_move(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 5, 10), (1, 1, 10, 4, 15, 14), (1, 2, 20, 9, 25, 19)], "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long")
    assert [r.line_index for r in R.order_regions(df).orderBy("region_id").collect()] == [0, 0, 1]


def test_duplicates_compare_with_kept_only(spark):
    rows, df = pages(spark, 2, wide=6)
    want = {}
    for p in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[2], r[1])):
            same = next((k for k in kept if share(r, k) >= 0.5 and r[6] == k[6]), None)
            want[p, r[1]] = same[1] if same else None
            kept += [] if same else [r]
    assert {(r.page_id, r.region_id): r.duplicate_of for r in R.suppress_duplicates(df, threshold=0.5).collect()} == want
    assert any(v is not None for v in want.values())


def test_matches_and_failures(spark):
    (a, ref), (b, pred) = pages(spark, 3), pages(spark, 4)
    want, used = {}, set()
    for r in sorted(a, key=lambda r: r[:2]):
        free = [p for p in sorted(b, key=lambda p: p[:2]) if p[0] == r[0] and p[:2] not in used]
        best = max(free, key=lambda p: share(r, p), default=None)
        if best and share(r, best) >= 0.2:
            want[r[:2]] = best[:2]
            used.add(best[:2])
    got = {(r.page_id, r.ref_id): (r.page_id, r.pred_id) for r in M.match_regions(ref, pred, least=0.2).collect()}
    assert got == want and got
    ordered = lambda df: df.withColumn("reading_index", F.col("region_id"))
    rows = M.attribute_failures(ordered(ref), ordered(pred), least_iou=0.2).collect()
    kinds = lambda k: {(r.page_id, r.region_id, r.matched_region_id) for r in rows if r.failure_type == k}
    text, ids = {r[:2]: r[6] for r in a} , {r[:2]: r[6] for r in b}
    assert kinds("detection_failure") == {(p, r, None) for p, r in {x[:2] for x in a} - set(want)}
    assert kinds("overlap_duplicate_failure") == {(p, None, r) for p, r in {x[:2] for x in b} - used}
    assert kinds("ocr_failure") == {(k[0], k[1], v[1]) for k, v in want.items() if text[k] != ids[v]}
    assert kinds("ordering_failure") == {(k[0], k[1], v[1]) for k, v in want.items() if k[1] != v[1]}
    sm = {(r.page_id, r.reason, r.region_id, r.overlap_count) for r in M.split_merge(ref, pred).collect()}
    cover = lambda x, y: max(min(x[4], y[4]) - max(x[2], y[2]), 0) * max(min(x[5], y[5]) - max(x[3], y[3]), 0) / ((x[4] - x[2]) * (x[5] - x[3]))
    n = {("reference_region_split_across_predictions", x[:2]): sum(y[0] == x[0] and cover(x, y) >= 0.35 for y in b) for x in a} | {("predicted_region_merges_references", y[:2]): sum(y[0] == x[0] and cover(x, y) >= 0.35 for x in a) for y in b}
    assert sm == {(k[0], why, k[1], c) for (why, k), c in n.items() if c > 1}
    assert len(kinds("split_merge_failure")) == len(sm)
    late = M.attribute_failures(ordered(ref), ordered(pred).withColumn("best_text", F.lit("zz")), least_iou=0.2).where("failure_type = 'postprocess_failure'").count()
    assert late == sum(ids[v] != "" for v in want.values())
    assert detection_scores(M.match_regions(ref, pred, least=0.2), len(a), len(b))["recall"] == len(want) / len(a) and composite_score(1, 1, 0, 0) == 1.0


def test_page_baseline(spark):
    rows, df = pages(spark, 5)
    assert {r.page_cer for r in page_baseline(df, "oracle").collect()} == {0.0}
    empty = page_baseline(df, "empty").collect()
    assert {r.page_cer for r in empty if r.reference_length} == {1.0} and len(empty) == 40


def test_missing_prediction_raises(spark):
    ref = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, page_text string")
    with pytest.raises(Exception, match="missing prediction"):
        evaluate_pages(ref, ref.where("page_id = 1")).collect()
    assert evaluate_pages(ref, ref.where("page_id = 1"), strict=False).where("page_cer = 1").count() == 1


def test_small_and_wide_pages_together(spark):
    """Pages of 1 to 200 regions, a null page and string ids: many at a time gives what a page alone gives, over batches of any size."""
    rng, rows = random.Random(9), []
    for p in [*range(30), None]:
        for k in rng.sample(range(1000), rng.choice([1, 3, 24, 64, 65, 200])):
            x, y = rng.randrange(90), rng.randrange(90)
            rows.append((p, f"r{k}", x, y, x + rng.randrange(1, 25), y + rng.randrange(1, 25), rng.choice(["a", "b", "", None])))
    df = spark.createDataFrame(rows, "page_id long, region_id string, x1 long, y1 long, x2 long, y2 long, text string")
    shifted = df.selectExpr("page_id", "region_id", "x1 + 1 AS x1", "y1", "x2 + 1 AS x2", "y2", "text")
    want_lines, want_texts, want_pairs = {}, {}, {}
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        b = np.array([r[2:6] for r in own], float)
        line, read = R._lines(b, [r[1] for r in own], 0.5)
        want_lines |= {(p, own[k][1]): (int(line[k]), n) for n, k in enumerate(read)}
        want_texts[p] = "\n".join(own[k][6] for k in read if own[k][6])
        free = {r[1]: (0, 0, r[2] + 1, r[3], r[4] + 1, r[5]) for r in own}
        for r in sorted(own, key=lambda r: r[1]):
            best = max(sorted(free), key=lambda k: share((0, 0, *r[2:6]), free[k]), default=None)
            if best is not None and share((0, 0, *r[2:6]), free[best]) >= 0.2:
                want_pairs[p, r[1]] = best
                del free[best]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert {(r.page_id, r.region_id): (r.line_index, r.reading_index) for r in R.order_regions(df).collect()} == want_lines
            assert {r.page_id: r.t for r in R.assembled_texts(df, {"t": "text"}, F.lit(True)).collect()} == want_texts
            assert {(r.page_id, r.ref_id): r.pred_id for r in M.match_regions(df, shifted, least=0.2).collect()} == want_pairs
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_pages_are_not_folded_one_by_one(spark):
    _, df = pages(spark, 5)
    for out in (R.order_regions(df), M.match_regions(df, df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_failures_of_many_pages_at_once(spark):
    """Texts and places that are null, chosen hypotheses, wide pages: counts and details as by plain loops, rows by page in order."""
    rng, sides = random.Random(21), []
    for _ in range(2):
        rows = []
        for p in [*range(12), None]:
            for k in range(rng.choice([0, 1, 5, 24, 90])):
                x, y = rng.randrange(60), rng.randrange(60)
                rows.append((p, k, x, y, x + rng.randrange(1, 25), y + rng.randrange(1, 25), rng.choice(["a", "b", "", None]), rng.choice(["a", None]), rng.choice([k, k, None, 0])))
        sides.append(rows)
    schema = "page_id long, region_id long, x1 long, y1 long, x2 long, y2 long, text string, best_text string, reading_index long"
    got = {}
    for r in M.attribute_failures(*(spark.createDataFrame(x, schema) for x in sides), least_iou=0.2).collect():
        got.setdefault(r.page_id, []).append((r.failure_type, r.region_id, r.matched_region_id, r.iou and round(r.iou, 9), r.details))
    cover = lambda a, c: max(min(a[4], c[4]) - max(a[2], c[2]), 0) * max(min(a[5], c[5]) - max(a[3], c[3]), 0) / ((a[4] - a[2]) * (a[5] - a[3])) >= 0.35
    best = lambda r: r[6] if r[7] is None else r[7]
    want = {}
    for p in {r[0] for rows in sides for r in rows}:
        refs, preds = ([r for r in rows if r[0] == p] for rows in sides)
        out = [("split_merge_failure", a[1], None, None, {"reason": "reference_region_split_across_predictions", "overlap_count": str(n)}) for a in refs if (n := sum(cover(a, c) for c in preds)) > 1]
        out += [("split_merge_failure", None, c[1], None, {"reason": "predicted_region_merges_references", "overlap_count": str(n)}) for c in preds if (n := sum(cover(a, c) for a in refs)) > 1]
        free = list(preds)
        for a in refs:
            c = max(free, key=lambda c: share(a, c), default=None)
            if c is None or share(a, c) < 0.2:
                out.append(("detection_failure", a[1], None, None, {"reason": "reference_region_unmatched"}))
                continue
            free.remove(c)
            pair = (a[1], c[1], round(share(a, c), 9))
            out += [("ordering_failure", *pair, {"reference_order": str(a[8]), "predicted_order": str(c[8])})] if a[8] != c[8] else []
            out += [("ocr_failure", *pair, {"reason": "matched_region_text_mismatch", "reference_text": best(a), "predicted_text": best(c)})] if best(a) != best(c) else []
            out += [("postprocess_failure", *pair, {"reason": "stored_text_differs_from_selected_hypothesis", "stored_text": c[6], "selected_text": best(c)})] if c[6] and c[6] != best(c) else []
        out += [("overlap_duplicate_failure", None, c[1], None, {"reason": "predicted_region_unmatched"}) for c in free]
        if out:
            want[p] = out
    assert got == want
