import difflib
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import blocks
from pagemill.functions import geometry as G
from pagemill.functions import hashing as H
from pagemill.functions import text as X
from pagemill.operators import metrics as A
from pagemill.functions.document import best_text, document_pages, page_predictions
from pagemill.operators.recognizers import recognize, recognizer
from pagemill.operators.selection import RegionFilter


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("v")).first().v


@pytest.mark.parametrize(("ref", "pred", "want"), [("", "", 0.0), ("", "x", 1.0), ("ab", "abcdef", 2.0), ("їжак", "ижак", 0.25), ("𝔘b", "b", 0.5)])
def test_error_rate(spark, ref, pred, want):
    assert one(spark, X.error_rate(F.col("a"), F.col("b")), a=ref, b=pred) == want


def test_length_buckets(spark):
    got = spark.createDataFrame([("x" * n,) for n in (0, 5, 6, 120, 121)], "t string").select(X.length_bucket(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == ["000_005", "000_005", "006_015", "061_120", "121_plus"]


@pytest.mark.parametrize(("text", "want"), [("a b a a", True), ("x y x x", True), ("a a a", False), ("aaaaaa", True), ("aaaaa", False), ("aaa aaa", True), ("", False)])
def test_repeats(spark, text, want):
    assert one(spark, X.repeats_itself(F.col("t")), t=text) is want


def test_strip_and_drift(spark):
    assert one(spark, X.stripped(F.col("t")), t=" \x1c a b \n") == "a b"
    assert one(spark, X.punctuation_only(F.col("a"), F.col("b")), a="abc", b=" .,_! ") is True
    assert one(spark, X.punctuation_only(F.col("a"), F.col("b")), a="...", b=" ... ") is False


def test_long_edit_distances(spark):
    import random

    rng, rows = random.Random(3), [("", "x"), ("same", "same"), (None, "ab"), ("слон", "слін"), ("ab", None)]
    for n in (3, 30, 450, 900):
        for _ in range(6):
            a = "".join(rng.choice("abcдє ") for _ in range(n))
            b = list(a)
            for _ in range(rng.randrange(n)):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
            rows.append((a, "".join(b)))
    d = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    for long in (0, 400):
        got = spark.createDataFrame(rows, "a string, b string").select(X.edit_distance(F.col("a"), F.col("b"), long).alias("x"), F.levenshtein(*d).alias("y")).collect()
        assert all(r.x == r.y for r in got) and len(got) == len(rows)


def test_edit_profile(spark):
    r = spark.createDataFrame([("ad", "dd"), ("слон", "слін"), ("same", "same"), (None, "x")], "a string, b string").select(X.edit_profile("a", "b").alias("e")).collect()
    assert tuple(r[0].e) == (1, 1, 0, 1, 0) and tuple(r[1].e) == (0, 0, 1, 3, 1) and tuple(r[2].e) == (0, 0, 0, 4, 0) and tuple(r[3].e) == (1, 0, 0, 0, 0)


def test_unicode(spark):
    t = "е́�\x07z𝔘"
    c = spark.createDataFrame([(t,)], "t string").select(*(v.alias(k) for k, v in X.code_point_counts(F.col("t")).items()), X.code_points("t").alias("p"), X.normal_forms("t").alias("n"), X.utf8_hex(F.col("t")).alias("h"), X.nfc("t").alias("c")).first()
    assert (c.n_chars, c.n_replacement, c.n_control, c.n_non_ascii, c.n_cyrillic) == (6, 1, 1, 4, 1)
    assert c.p[3].code == "U+0007" and c.p[3].category == "Cc" and c.n.is_nfd and c.h == t.encode().hex()


def test_unicode_summary(spark):
    u = spark.createDataFrame([("e\u0301\ufffd\u200b\x07",), (None,)], "t string").select(X.unicode_summary("t").alias("u")).collect()
    a, b = u[0].u, u[1].u
    assert (a.length, a.is_nfc, a.is_nfd, a.nfc_repr, a.n_replacement, a.n_control) == (5, False, True, repr("\u00e9\ufffd\u200b\x07"), 1, 2)  # formats count as control
    assert [p.is_control for p in a.codepoints] == [False, False, False, True, True] and a.codepoints[4].name == "<unnamed>" and a.codepoints[2].is_replacement
    assert (b.length, b.repr, b.codepoints) == (0, "''", [])


def test_document_pages_there_and_back(spark):
    kind = "image_id string, width int, height int, regions array<struct<bbox:struct<x1:int,y1:int,x2:int,y2:int>,type:string,text:string,language:string,score:double>>"
    rows = [("a.jpg", 10, 20, [((1, 2, 3, 4), "printed", "x", "uk", 0.5), ((1, 2, 3, 4), "printed", "x", None, None)]), ("b.jpg", 1, 1, []), ("c.jpg", 1, 1, None)]
    pages = spark.createDataFrame(rows, kind)
    docs = {r.page_id: r for r in document_pages(pages).collect()}
    first = docs["a.jpg"].regions[0]
    want = "region_" + hashlib.sha1(b"a.jpg|(1, 2, 3, 4)|printed|0").hexdigest()[:16]
    assert first.region_id == want == first.lineage[0] and first.ocr_hypotheses[0].hypothesis_id == "ocr_" + hashlib.sha1(f"{want}|x".encode()).hexdigest()[:16]
    assert len({r.region_id for r in docs["a.jpg"].regions}) == 2 and docs["b.jpg"].regions == [] and docs["c.jpg"].regions is None
    back = {r.image_id: r for r in page_predictions(document_pages(pages)).collect()}
    assert [(tuple(r.bbox), r.type, r.text, r.language, r.score) for r in back["a.jpg"].regions] == rows[0][3]


def test_handwriting(spark):
    assert one(spark, X.handwriting_bucket(F.lit("Hand printed"), F.lit(None))) == "printed"
    assert one(spark, X.handwriting_bucket(F.lit("manuscript"))) == "handwritten" and one(spark, X.handwriting_bucket(F.lit(None))) == "unknown"


def test_boxes(spark):
    box = lambda *v: G.box(*(F.lit(x) for x in v))
    a, b, c = box(0, 0, 10, 10), box(0, 0, 10, 5), box(10, 0, 20, 10)
    v = lambda e: one(spark, e)
    assert (v(G.iou(a, b)), v(G.iou(a, c)), v(G.coverage(a, b)), v(G.coverage(b, a)), v(G.area(box(5, 5, 4, 9)))) == (0.5, 0.0, 0.5, 1.0, 0)
    assert tuple(v(G.from_numbers(F.array(*map(F.lit, (0.5, 1.5, 2.5, 3.5)))))) == (0, 2, 2, 4)
    assert v(G.from_numbers(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))) is None
    assert tuple(v(G.padded(box(2, 2, 9, 9), 8, F.lit(12), F.lit(10)))) == (0, 0, 12, 10) and v(G.padded(box(30, 30, 40, 40), 2, F.lit(12), F.lit(10))) is None
    assert v(G.height(box(0, 5, 1, 5))) == 1 and v(G.y_center(b)) == 2.5 and tuple(v(G.union(F.array(a, c)))) == (0, 0, 20, 10)


def test_hashes(spark):
    rows = spark.range(200).select("id", H.bucket(F.col("id"), 42).alias("b"), H.stable_id("r", F.col("id"), F.lit(None), H.box_text(G.box(*(F.lit(x) for x in (1, 2, 3, 4))))).alias("s")).collect()
    for r in rows:
        assert r.b == int(hashlib.sha256(f"42:{r.id}".encode()).hexdigest(), 16) % 10_000
        assert r.s == "r_" + hashlib.sha1(f"{r.id}||(1, 2, 3, 4)".encode()).hexdigest()[:16]
    with pytest.raises(ValueError):
        H.split_name(F.col("id"), 1.0, 42)


def test_filter_reasons(spark):
    rows = [("formula", "uk", "legible", "x"), ("printed", None, "legible", "x"), ("printed", "uk", None, "x"), ("printed", "uk", "legible", ""), ("printed", "uk", "legible", " "), ("printed", "uk", "legible", "xxxx")]
    df = spark.createDataFrame(rows, "t string, l string, g string, x string")
    cols = [F.col(c) for c in "tlgx"]
    box = G.box(*(F.lit(x) for x in (0, 0, 1, 1)))
    got = [r.v for r in df.select(RegionFilter(max_length=3).reason(*cols, box).alias("v")).collect()]
    assert got == ["excluded_type:formula", "excluded_language:None", "excluded_legibility:None", "empty_or_too_short_text", None, "too_long_text"]
    assert df.limit(1).select(RegionFilter(types=("formula",)).reason(*cols, F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")).alias("v")).first().v == "invalid_bbox"


def test_histogram_and_ranks(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (1.4,), (-0.1,)], "cer double")
    assert {r.bin: r.n_rows for r in A.rate_histogram(df).collect()} == {"0.00_0.05": 1, "0.05_0.10": 1, "0.10_0.25": 0, "0.25_0.50": 0, "0.50_1.00": 0, "1.00_inf": 2}
    r = A.nearest_ranks(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double"), "v", {"p50": 0.5, "top": 1.0}).first()
    assert (r.n_rows, r.p50, r.top) == (4, 3.0, 4.0)
    m = spark.createDataFrame([(1, 1, 1.0), (0, 9, 0.0)], "edit_distance int, reference_length int, cer double").agg(*A.summary()).first()
    assert (m.micro_cer, m.mean_cer) == (0.1, 0.5)


def test_groups_take_nulls_and_lists(spark):
    df = spark.createDataFrame([(1, 2, 0.5, None, ["a", "b"]), (0, 2, 0.0, "s", [])], "edit_distance int, reference_length int, cer double, source string, tags array<string>")
    got = {(r.key, r.bucket): r.n_rows for r in A.grouped_summary(df, ["source", "tags"]).collect()}
    assert got == {("source", "None"): 1, ("source", "s"): 1, ("tags", "a"): 1, ("tags", "b"): 1}


def test_recognizers(spark):
    df = spark.createDataFrame([("printed", "abc"), ("image", "abc"), ("printed", None)], "region_type string, text string")
    assert [(r.predicted_text, r.score) for r in recognize(df, "oracle").collect()] == [("abc", 1.0), ("", None), ("", 1.0)]
    assert {r.predicted_text for r in recognize(df, "empty").collect()} == {""}
    with pytest.raises(ValueError):
        recognizer("none such")
    h = spark.sql("SELECT array(named_struct('rank', 2, 'text', 'b'), named_struct('rank', 1, 'text', 'a')) AS h, 'stored' AS t, array() AS e")
    assert h.select(best_text(F.col("h"), F.col("t")).alias("v")).first().v == "a"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=8)), min_size=1, max_size=20))
def test_rates_are_symmetric_in_distance(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    pairs = [(a.encode("utf-8", "ignore").decode().replace("\x00", ""), b.encode("utf-8", "ignore").decode().replace("\x00", "")) for a, b in pairs]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("x"), F.levenshtein("b", "a").alias("y"), X.error_rate(F.col("a"), F.col("a")).alias("z")).collect():
        assert r.x == r.y and r.z == 0.0 and (r.x == 0) == (r.a == r.b)


def _plain_edits(a, b):
    """Counts from difflib's blocks, gap by gap."""
    i = j = 0
    out = [0] * 5
    for x, y, size in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        lost, new = a[i:x], b[j:y]
        kind = 2 if lost and new else 0 if new else 1
        out[kind] += max(len(lost), len(new))
        out[3] += size
        out[4] += sum(p != q and "\u0400" <= p <= "\u04ff" and "\u0400" <= q <= "\u04ff" for p, q in zip(lost, new))
        i, j = x + size, y + size
    return out


def _text_pairs():
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    noisy = lambda a, letters, p: "".join(rng.choice(letters) if rng.random() < p else c for c in a if rng.random() > p / 2)
    pairs = [("a" * 50, "a" * 30), ("ab" * 30, "ba" * 30), ("", ""), ("x", ""), ("", "yy"), ("abcabcabc", "abc"), ("😀é", "é😀"), ("ab" * 200, "b" + "ab" * 150)]
    for k in range(600):
        letters = rng.choice(["ab", "abc ", "абвґд x", "etaoin shrdlu"])
        a = text(rng.randrange(60), letters)
        pairs.append((a, text(rng.randrange(60), letters) if k % 2 else noisy(a, letters, rng.choice([0.05, 0.3]))))
    a = text(3000, "etaoin shrdlu")
    return [*pairs, (a, noisy(a, "etaoin shrdlu", 0.1))]


@pytest.mark.parametrize("cells", [blocks.CELLS, 300, 1])
def test_matching_blocks(cells):
    """As difflib has them, whether pairs are compared at once (many cells) or cut by the automaton down to single characters."""
    pairs = _text_pairs() if cells > 1 else _text_pairs()[:200]
    pair, i, j, size = blocks.matching_blocks([a for a, _ in pairs], [b for _, b in pairs], cells)
    found = [[] for _ in pairs]
    for k, *block in zip(*(x.tolist() for x in (pair, i, j, size))):
        found[k].append(tuple(block))
    assert found == [[tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]] for a, b in pairs]
    assert blocks.edit_counts([a for a, _ in pairs], [b for _, b in pairs], cells).tolist() == [_plain_edits(a, b) for a, b in pairs]


def test_distances_of_many_pairs_at_once(spark):
    rng, rows = random.Random(11), [("", ""), (None, "ab"), ("ab", None), ("", "ab"), ("ab", ""), ("ab", "ab"), ("a\x00", "\x00a")]
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefgh ", "aбв\U0001f600"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 63, 64, 65, 80, 127, 128, 129, 256, 257])))
        b = "".join(c for c in a if rng.random() < 0.9) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.choice([1, 64, 80, 130, 260])))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("x", X.edit_distance(F.col("a"), F.col("b")))
    want = F.levenshtein(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).cast("long")
    assert df.where(~F.col("x").eqNullSafe(want)).count() == 0
    assert [X._steps(a or "", b or "") for a, b in rows] == X.distances([a or "" for a, _ in rows], [b or "" for _, b in rows]).tolist()


def test_a_rate_is_worked_out_once(spark):
    """A filter on what follows from a rate stays above it, and no query compares regions by the built-in cell by cell."""
    df = spark.range(5).selectExpr("cast(id as string) AS a", "'2' AS b").withColumn("d", X.edit_distance(F.col("a"), F.col("b")))
    rated = df.withColumn("cer", X.error_rate(F.col("a"), F.col("b"), F.col("d"))).where("cer > 0")
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unequal(") == 1 and "levenshtein" not in plan
    assert rated.count() == 4


def test_blocks_of_two_and_of_one():
    """Single equal characters count only in the gaps that longer runs leave, whatever number of cells is compared at once."""
    rng, pairs = random.Random(12), [("", "a"), ("a", "a"), ("ab", "ba"), ("xaby", "abxy"), ("\xfe\xff", "\xff\xfe")]
    for _ in range(80):
        letters = rng.choice(["ab", "abcdefgh ", "aбв\U0001f600", "a"])
        pairs.append(tuple("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 40]))) for _ in range(2)))
    ones, twos = [a for a, _ in pairs], [b for _, b in pairs]
    want = [(k, m.a, m.b, 1) for k, (a, b) in enumerate(pairs) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1] for _ in range(1)]
    for cells in (1 << 20, 500, 60):
        pair, i, j, size = blocks.matching_blocks(ones, twos, cells)
        whole = {(p, x + d, y + d) for p, x, y, n in zip(pair.tolist(), i.tolist(), j.tolist(), size.tolist()) for d in range(n)}
        assert whole == {(k, m.a + d, m.b + d) for k, (a, b) in enumerate(pairs) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for d in range(m.size)}


def test_runs_of_one_character_are_not_listed():
    """They are most runs of two texts; listing and cutting them took most of the time of an edit profile."""
    pair, i, j, size = blocks._runs(["abcabc"], ["cabxbca"])
    assert size.min() >= 2 and sorted(zip(i.tolist(), j.tolist(), size.tolist())) == [(1, 4, 3), (2, 0, 3), (4, 4, 2)] or sorted(zip(i.tolist(), j.tolist(), size.tolist())) == sorted(
        (x, y, n) for x in range(6) for y in range(7) for n in [next((d for d in range(8) if "abcabc"[x : x + d + 1] != "cabxbca"[y : y + d + 1] or x + d >= 6 or y + d >= 7), 0)] if n >= 2 and not (x and y and "abcabc"[x - 1] == "cabxbca"[y - 1]))


@pytest.mark.parametrize("text", ["　 a b\x1c\x85", "\n\n", "", "a", "\x1fa  ", "​a᠎"])
def test_stripped_equals_the_pattern(spark, text):
    assert one(spark, X.stripped(F.col("a")), a=text) == one(spark, F.regexp_replace("a", rf"(?U)^{X.BLANK}+|{X.BLANK}+$", ""), a=text)
