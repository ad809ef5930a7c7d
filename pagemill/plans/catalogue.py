"""The registered queries over annotated pages and texts, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import document as D
from pagemill.functions import geometry as G
from pagemill.functions import hashing as H
from pagemill.functions import text as X
from pagemill.operators import errors as E
from pagemill.operators import matching as M
from pagemill.operators import metrics as A
from pagemill.operators import reading_order as R
from pagemill.operators import recognizers as RG
from pagemill.operators import scoring as S
from pagemill.operators import selection as L
from pagemill.operators.pages import BOX
from pagemill.plans import builders as B
from pagemill.plans import datasets as P
from pagemill.plans import inspection as I
from pagemill.plans import views as V
from pagemill.plans.views import IOU, V1, table
from pagemill.sources import data_sets as DS
from pagemill.sources import kept as K
from pagemill.sources import positions as O
from pagemill.sources import readers as S_
from pagemill.sources import records as RE
from pagemill.sources import sinks as W
from pagemill.streaming import ingest as SI
from pagemill.streaming import last_rows as SL

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED, FRACTION = 42, 0.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that engines which sum in another order agree."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def even(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the session asks for: the work on them is heavy for their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _split_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumns({"split": H.split_name(F.col("doc_id"), FRACTION, SEED), "exact_text": X.stripped(F.col("text"))})


_TERMS = " + ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) * {pow(16, 8 * (7 - k), 10_000)}" for k in range(8))
_STRIP = r"regexp_replace(text, '^[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"
DOCS = f"""
split_docs AS (SELECT doc_id, text, lang, source, {_STRIP} AS exact_text, CASE WHEN ({_TERMS}) % 10000 < {int(FRACTION * 10_000)} THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, sha256('{SEED}:' || doc_id) AS d FROM documents))"""
WITH, REC = "WITH ", "WITH RECURSIVE "


# ---- pages and rates ------------------------------------------------------------------------------------------------
@query(REC + V.LINES + r""",
texts AS (SELECT page_id, any_value(source) AS source,
  coalesce(string_agg(ref_text, chr(10) ORDER BY reading_index) FILTER (WHERE ok AND ref_text <> ''), '') AS r,
  coalesce(string_agg(pred_text, chr(10) ORDER BY reading_index) FILTER (WHERE ok AND pred_text <> ''), '') AS p
  FROM (SELECT *, region_type NOT IN ('image', 'graph') AND (language IS NULL OR language = 'uk') AND (legibility IS NULL OR legibility = 'legible') AS ok FROM ordered) GROUP BY page_id)
SELECT source, count(*) AS n_pages, CAST(sum(levenshtein(r, p)) AS BIGINT) AS edit_distance, CAST(sum(length(r)) AS BIGINT) AS reference_length,
  round(CASE WHEN sum(length(r)) > 0 THEN CAST(sum(levenshtein(r, p)) AS DOUBLE) / sum(length(r)) ELSE 0.0 END, 6) AS page_cer FROM texts GROUP BY source""")
def page_cer_by_source(spark, sf):
    v = V.regions(spark, sf)
    ok = R.text_evaluable(F.col("region_type"), F.col("language"), F.col("legibility"))
    pages = R.assembled_texts(v, {"r": "ref_text", "p": "pred_text"}, ok, ("source",))
    return six(S.mean_page_rate(pages.withColumns({"edit_distance": X.edit_distance(F.col("r"), F.col("p")), "reference_length": F.length("r").cast("long")}), "source"))


@query(WITH + V.SCORED + """
SELECT source, count(*) AS n_rows, round(CAST(sum(edit_distance) AS DOUBLE) / sum(reference_length), 6) AS micro_cer, round(avg(cer), 6) AS mean_cer FROM sc GROUP BY source""")
def region_cer_summary(spark, sf):
    return six(V.scored(spark, sf).groupBy("source").agg(*A.summary()))


@query(WITH + V.SCORED + """,
r AS (SELECT source, cer, row_number() OVER (PARTITION BY source ORDER BY cer) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM sc)
SELECT source, any_value(n) AS n_rows, max(CASE WHEN k = round_even((n - 1) * 0.5, 0) THEN cer END) AS p50, max(CASE WHEN k = round_even((n - 1) * 0.75, 0) THEN cer END) AS p75,
  max(CASE WHEN k = round_even((n - 1) * 0.95, 0) THEN cer END) AS p95, max(CASE WHEN k = n - 1 THEN cer END) AS max_cer FROM r GROUP BY source""")
def nearest_rank_percentiles(spark, sf):
    return A.nearest_ranks(V.scored(spark, sf), "cer", {"p50": 0.5, "p75": 0.75, "p95": 0.95, "max_cer": 1.0}, ["source"])


@query(WITH + V.SCORED + """,
bins(bin, low, high) AS (VALUES ('0.00_0.05', 0.0, 0.05), ('0.05_0.10', 0.05, 0.1), ('0.10_0.25', 0.1, 0.25), ('0.25_0.50', 0.25, 0.5), ('0.50_1.00', 0.5, 1.0), ('1.00_inf', 1.0, 1e300))
SELECT bin, count(cer) AS n_rows FROM bins LEFT JOIN sc ON cer >= CAST(low AS DOUBLE) AND cer < CAST(high AS DOUBLE) GROUP BY bin""")
def cer_histogram(spark, sf):
    return A.rate_histogram(V.scored(spark, sf))


_KEYS = ("source", "language", "legibility", "region_type", "text_length_bucket")
_BUCKET = "CASE WHEN n <= 5 THEN '000_005' WHEN n <= 15 THEN '006_015' WHEN n <= 30 THEN '016_030' WHEN n <= 60 THEN '031_060' WHEN n <= 120 THEN '061_120' ELSE '121_plus' END"


@query(WITH + V.SCORED + f", b AS (SELECT *, {_BUCKET} AS text_length_bucket FROM sc)\n" + " UNION ALL ".join(f"SELECT '{k}' AS key, coalesce({k}, 'None') AS bucket, count(*) AS n_rows, round(CASE WHEN sum(reference_length) > 0 THEN CAST(sum(edit_distance) AS DOUBLE) / sum(reference_length) ELSE 0.0 END, 6) AS micro_cer, round(avg(cer), 6) AS mean_cer FROM b GROUP BY 2" for k in _KEYS))
def cer_grouping_sets(spark, sf):
    return six(A.grouped_summary(V.scored(spark, sf).withColumn("text_length_bucket", X.length_bucket(F.col("ref_text"))), list(_KEYS)))


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n_rows, min(n) AS shortest, max(n) AS longest FROM (SELECT length(text) AS n FROM documents) WHERE n IS NOT NULL GROUP BY 1")
def text_length_buckets(spark, sf):
    n = F.length("text").cast("long")
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy(X.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n_rows"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


_SHARES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query("SELECT lang, min(length(text)) AS shortest, " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS {k}" for k, q in _SHARES.items()) + ", max(length(text)) AS longest, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY lang")
def text_length_percentiles(spark, sf):
    n = F.length("text").cast("long")
    return table(spark, sf, "documents").groupBy("lang").agg(F.min(n).alias("shortest"), *A.linear_percentiles(n, _SHARES), F.max(n).alias("longest"), F.avg(n).alias("mean_length")).select("lang", "shortest", "longest", *(F.round(c, 6).alias(c) for c in (*_SHARES, "mean_length")))


@query(WITH + V.SCORED + " SELECT region_id, cer, reference_length FROM sc ORDER BY cer DESC, reference_length DESC, region_id LIMIT 25")
def worst_k(spark, sf):
    return A.worst(V.scored(spark, sf).select("region_id", "cer", "reference_length"), 25, tie="region_id")


@query(WITH + V.SCORED + " SELECT region_id, cer, reference_length FROM sc WHERE cer > 0 ORDER BY reference_length DESC, cer DESC, region_id LIMIT 25")
def longest_failures(spark, sf):
    return A.worst(V.scored(spark, sf).where("cer > 0").select("region_id", "cer", "reference_length"), 25, ("reference_length", "cer"), "region_id")


# ---- splits, filters, samples ---------------------------------------------------------------------------------------
@query(WITH + DOCS + " SELECT doc_id, split FROM split_docs")
def hash_split_assignments(spark, sf):
    return _split_docs(spark, sf).select("doc_id", "split")


@query(WITH + DOCS + " SELECT split, source, count(*) AS n_rows FROM split_docs GROUP BY 1, 2")
def source_split_pivot(spark, sf):
    return _split_docs(spark, sf).groupBy("split", "source").agg(F.count("*").alias("n_rows"))


_FILTER = L.RegionFilter(max_length=75)
_REASON = """CASE WHEN region_type NOT IN ('handwritten', 'printed') THEN 'excluded_type:' || region_type
  WHEN coalesce(language, 'None') <> 'uk' THEN 'excluded_language:' || coalesce(language, 'None')
  WHEN coalesce(legibility, 'None') <> 'legible' THEN 'excluded_legibility:' || coalesce(legibility, 'None')
  WHEN n < 1 THEN 'empty_or_too_short_text' WHEN n > 75 THEN 'too_long_text' END"""


def _decided(spark, sf):
    v = V.regions(spark, sf)
    return v.withColumn("reason", _FILTER.reason(F.col("region_type"), F.col("language"), F.col("legibility"), F.col("ref_text"), G.box("x1", "y1", "x2", "y2")))


@query(WITH + V1 + f" SELECT coalesce({_REASON}, 'keep') AS reason, count(*) AS n_rows FROM v1 GROUP BY 1")
def region_filter_reasons(spark, sf):
    return _decided(spark, sf).groupBy(F.coalesce("reason", F.lit("keep")).alias("reason")).agg(F.count("*").alias("n_rows"))


_PAGE_SPLIT = f"SELECT page_id, CASE WHEN ({_TERMS}) % 10000 < 2000 THEN 'val' ELSE 'train' END AS split FROM (SELECT page_id, sha256('42:' || page_id) AS d FROM v1 GROUP BY page_id)"


@query(WITH + V1 + f"""
SELECT printf('%d.jpg::r%04d', v1.page_id, i) AS crop_id, split, printf('crops/%s/%d__r%04d.png', split, v1.page_id, i) AS crop_path, v1.page_id, i AS region_index, ref_text AS text, region_type, language, legibility,
  greatest(0, x1 - 8) AS px1, greatest(0, y1 - 8) AS py1, least(400, x2 + 8) AS px2, least(200, y2 + 8) AS py2, source
FROM v1 JOIN ({_PAGE_SPLIT}) s ON v1.page_id = s.page_id WHERE ({_REASON}) IS NULL""")
def export_manifest(spark, sf):
    rows = _decided(spark, sf).where("reason IS NULL").withColumn("split", H.split_name(F.col("page_id"), FRACTION, SEED))
    p = G.padded(G.box("x1", "y1", "x2", "y2"), 8, F.lit(400), F.lit(200))
    rows = rows.withColumn("p", p).where("p IS NOT NULL")
    return rows.select(F.format_string("%d.jpg::r%04d", "page_id", "i").alias("crop_id"), "split", F.format_string("crops/%s/%d__r%04d.png", "split", "page_id", "i").alias("crop_path"), "page_id", F.col("i").alias("region_index"), F.col("ref_text").alias("text"), "region_type", "language", "legibility", *(F.col(f"p.{c}").cast("long").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")), "source")


@query(WITH + V1 + f""", d AS (SELECT *, ({_REASON}) IS NULL AS kept FROM v1)
SELECT coalesce(source, 'unknown') AS source, count(DISTINCT page_id) AS images_seen, count(*) AS regions_seen, count(*) FILTER (WHERE kept) AS regions_kept,
  count(DISTINCT CASE WHEN kept THEN page_id END) AS images_kept, min(CASE WHEN kept THEN n END) AS shortest, max(CASE WHEN kept THEN n END) AS longest, CAST(sum(CASE WHEN kept THEN n END) AS BIGINT) AS characters,
  round(avg(CASE WHEN kept THEN n END), 6) AS mean_length FROM d GROUP BY 1""")
def export_stats(spark, sf):
    kept = F.col("reason").isNull()
    n = F.when(kept, F.col("n"))
    return _decided(spark, sf).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count_distinct("page_id").alias("images_seen"), F.count("*").alias("regions_seen"), F.count_if(kept).alias("regions_kept"), F.count_distinct(F.when(kept, F.col("page_id"))).alias("images_kept"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("characters"), F.round(F.avg(n), 6).alias("mean_length"))


@query(WITH + V1 + """
SELECT source, max_by(page_id, struct_pack(a := area, b := -page_id)) AS largest_page, max(area) AS area FROM (SELECT source, page_id, max(x2) * max(y2) AS area FROM v1 GROUP BY 1, 2) GROUP BY source""")
def largest_page_by_source(spark, sf):
    pages = V.regions(spark, sf).groupBy("source", "page_id").agg((F.max("x2") * F.max("y2")).alias("area"))
    return pages.groupBy("source").agg(F.max_by("page_id", F.struct("area", -F.col("page_id"))).alias("largest_page"), F.max("area").alias("area"))


_TOKENS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"


def _annotated(spark, sf):
    tokens = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")
    return _split_docs(spark, sf).withColumn("token_length", tokens)


@query(WITH + DOCS + f"""
SELECT coalesce(CASE WHEN exact_text = '' THEN 'empty_text' WHEN {_TOKENS} > 128 THEN 'over_max_token_length' END, 'keep') AS reason, count(*) AS n_rows, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM split_docs GROUP BY 1""")
def drop_reason_partition(spark, sf):
    rows = _annotated(spark, sf).withColumn("reason", F.coalesce(L.drop_reason(F.col("text"), F.col("token_length"), 128), F.lit("keep")))
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"), F.sum("token_length").alias("tokens"))


@query(WITH + DOCS + f" SELECT doc_id, {_TOKENS} AS token_length FROM split_docs WHERE {_TOKENS} > 128 ORDER BY token_length DESC, doc_id LIMIT 200")
def overlength_report(spark, sf):
    return _annotated(spark, sf).where("token_length > 128").select("doc_id", "token_length").orderBy(F.desc("token_length"), "doc_id").limit(200)


_VAL = "val AS (SELECT doc_id, exact_text FROM (SELECT *, sha256('43:' || doc_id) AS k, row_number() OVER (PARTITION BY exact_text ORDER BY sha256('43:' || doc_id), doc_id) AS rn FROM split_docs WHERE split = 'val') WHERE rn = 1 ORDER BY k, doc_id LIMIT 100)"


def _val(spark, sf):
    return L.first_of_each(_split_docs(spark, sf).where("split = 'val'"), "exact_text", "doc_id", SEED + 1, 100)


@query(WITH + DOCS + ",\n" + _VAL + " SELECT doc_id FROM val")
def distinct_text_validation_sample(spark, sf):
    return _val(spark, sf).select("doc_id")


@query(WITH + DOCS + ",\n" + _VAL + " SELECT doc_id FROM split_docs WHERE split = 'train' AND exact_text NOT IN (SELECT exact_text FROM val) ORDER BY sha256('42:' || doc_id), doc_id LIMIT 300")
def leakfree_train_sample(spark, sf):
    train = L.leak_free(_split_docs(spark, sf).where("split = 'train'").select("doc_id", "exact_text"), _val(spark, sf), "exact_text")
    return L.in_shuffled_order(train, "doc_id", SEED, 300).select("doc_id")


@query(WITH + DOCS + """ SELECT count(*) AS raw_overlap, count(*) FILTER (WHERE length(exact_text) <= 2000) AS eligible_overlap FROM (
  SELECT exact_text FROM split_docs WHERE split = 'train' AND exact_text <> '' INTERSECT SELECT exact_text FROM split_docs WHERE split = 'val' AND exact_text <> '')""")
def exact_text_overlap(spark, sf):
    d = _split_docs(spark, sf).where("exact_text <> ''")
    both = d.where("split = 'train'").select("exact_text").intersect(d.where("split = 'val'").select("exact_text"))
    return both.agg(F.count("*").alias("raw_overlap"), F.count_if(F.length("exact_text") <= 2000).alias("eligible_overlap"))


@query(WITH + DOCS + """ SELECT md5(exact_text) AS text_md5, n_a, n_b FROM (SELECT exact_text, count(*) FILTER (WHERE split = 'train') AS n_a, count(*) FILTER (WHERE split = 'val') AS n_b FROM split_docs GROUP BY 1)
  WHERE n_a > 0 AND n_b > 0 ORDER BY n_a + n_b DESC, exact_text DESC LIMIT 50""")
def overlap_top_texts(spark, sf):
    d = _split_docs(spark, sf).select("split", "exact_text")
    both = L.overlap(d.where("split = 'train'"), d.where("split = 'val'"), "exact_text")
    return both.orderBy(F.desc(F.col("n_a") + F.col("n_b")), F.desc("exact_text")).limit(50).select(F.md5(F.col("exact_text").cast("binary")).alias("text_md5"), "n_a", "n_b")


@query(WITH + DOCS + " SELECT count(*) AS n_rows FROM split_docs WHERE split = 'val' AND exact_text IN (SELECT exact_text FROM split_docs WHERE split = 'train')")
def val_rows_with_train_text(spark, sf):
    d = _split_docs(spark, sf)
    return d.where("split = 'val'").join(d.where("split = 'train'").select("exact_text"), "exact_text", "left_semi").agg(F.count("*").alias("n_rows"))


@query(WITH + DOCS + ",\n" + _VAL + " SELECT count(*) AS n_rows FROM split_docs WHERE split = 'train' AND exact_text IN (SELECT exact_text FROM val)")
def train_rows_blocked(spark, sf):
    train = _split_docs(spark, sf).where("split = 'train'").select("exact_text")
    return train.join(_val(spark, sf).select("exact_text"), "exact_text", "left_semi").agg(F.count("*").alias("n_rows"))


_NUMBERS = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {k}" for k, q in I.SHARES.items())


@query(WITH + DOCS + f""", m AS (SELECT split, unnest(['text_length', 'n_chars']) AS measure, unnest([length(text), n_chars]) AS value FROM split_docs JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))
SELECT split, measure, count(value) AS n_rows, {_NUMBERS}, round(avg(value), 6) AS mean FROM m GROUP BY split, measure""")
def split_profile_numbers(spark, sf):
    return I.split_numbers(_split_docs(spark, sf), {"text_length": F.length("text"), "n_chars": F.col("n_chars")}, "split").transform(six)


@query("SELECT 'source' AS key, coalesce(source, 'None') AS value, count(*) AS n_rows FROM documents GROUP BY 2 UNION ALL SELECT 'lang', coalesce(lang, 'None'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'text_length_bucket', CASE WHEN n <= 5 THEN '000_005' WHEN n <= 15 THEN '006_015' WHEN n <= 30 THEN '016_030' WHEN n <= 60 THEN '031_060' WHEN n <= 120 THEN '061_120' ELSE '121_plus' END, count(*) FROM (SELECT length(coalesce(text, '')) AS n FROM documents) GROUP BY 2")
def split_profile_counts(spark, sf):
    return I.split_counts(table(spark, sf, "documents").select("source", "lang", "text"), ("source", "lang"))


@query("SELECT coalesce(lang, 'None') AS lang, coalesce(CAST(quality AS VARCHAR), 'None') AS quality, coalesce(CAST(toxic AS VARCHAR), 'None') AS toxic, count(*) AS n_rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def labelled_distribution(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in ("lang", "quality", "toxic"))).agg(F.count("*").alias("n_rows"))


@query(WITH + DOCS + """, expected(lang, name, expected_rows) AS (VALUES ('en', 'English', 600), ('fr', 'French', 150), ('de', 'German', 150), ('es', 'Spanish', 100))
SELECT name, CAST(expected_rows AS BIGINT) AS expected_rows, coalesce(n_rows, 0) AS n_rows, coalesce(n_val, 0) AS n_val, coalesce(n_rows, 0) - expected_rows AS difference FROM expected LEFT JOIN (SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE split = 'val') AS n_val FROM split_docs GROUP BY lang) USING (lang)""")
def split_reconciliation(spark, sf):
    expected = spark.createDataFrame([("en", "English", 600), ("fr", "French", 150), ("de", "German", 150), ("es", "Spanish", 100)], "lang string, name string, expected_rows long")
    seen = _split_docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(F.col("split") == "val").alias("n_val"))
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return expected.join(seen, "lang", "left").select("name", "expected_rows", n.alias("n_rows"), F.coalesce("n_val", F.lit(0)).cast("long").alias("n_val"), (n - F.col("expected_rows")).alias("difference"))


@query("SELECT b.item_id, count(d.t) AS n_docs FROM benchmark b LEFT JOIN (SELECT trim(text) AS t FROM documents) d ON trim(b.text) = d.t GROUP BY 1")
def benchmark_text_overlap(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    texts = d.groupBy(F.trim("text").alias("t_")).agg(F.count("*").alias("n"))
    both = b.select("item_id", F.trim("text").alias("t")).join(texts, F.col("t") == F.col("t_"), "left")
    return both.groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"))


# ---- runs ----------------------------------------------------------------------------------------------------------
def _compared(spark, sf):
    return E.compare_runs(V.scored(spark, sf), V.second_run(spark, sf), "region_id")


_BOTH = WITH + V.SECOND + ", c AS (SELECT coalesce(a.region_id, b.region_id) AS region_id, a.cer AS base_cer, b.cer AS candidate_cer, b.cer - a.cer AS delta FROM sc a FULL JOIN sc2 b ON a.region_id = b.region_id)"


@query(_BOTH + " SELECT count(delta) AS shared, count(*) FILTER (WHERE candidate_cer IS NULL) AS base_only, count(*) FILTER (WHERE base_cer IS NULL) AS candidate_only, round(avg(delta), 6) AS mean_delta, count(*) FILTER (WHERE delta > 0) AS regressions, count(*) FILTER (WHERE delta < 0) AS improvements FROM c")
def compare_runs_summary(spark, sf):
    return six(E.comparison_summary(_compared(spark, sf)))


@query(_BOTH + " SELECT region_id, base_cer, candidate_cer, delta FROM c WHERE delta > 0 ORDER BY delta DESC, region_id LIMIT 25")
def largest_regressions(spark, sf):
    return E.largest_changes(_compared(spark, sf), 25, True, "region_id").select("region_id", "base_cer", "candidate_cer", "delta")


@query(_BOTH + " SELECT region_id, base_cer, candidate_cer, delta FROM c WHERE delta < 0 ORDER BY delta ASC, region_id LIMIT 25")
def largest_improvements(spark, sf):
    return E.largest_changes(_compared(spark, sf), 25, False, "region_id").select("region_id", "base_cer", "candidate_cer", "delta")


@query(WITH + V.SECOND + """ SELECT count(*) AS overlap FROM ((SELECT region_id FROM sc ORDER BY cer DESC, region_id LIMIT 500) INTERSECT (SELECT region_id FROM sc2 ORDER BY cer DESC, region_id LIMIT 500))""")
def hardest_overlap_at_k(spark, sf):
    return E.hardest_overlap(V.scored(spark, sf), V.second_run(spark, sf), 500, "region_id")


# ---- texts ---------------------------------------------------------------------------------------------------------
_REPEATS = r"""(len(w) >= 4 AND list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) >= 3)
  OR len(list_filter(range(1, length(s) - 4), lambda k: substring(s, k, 6) = repeat(substring(s, k, 1), 6))) > 0"""


@query(rf"""SELECT conv_id, turn, coalesce({_REPEATS}, false) AS repeated FROM (SELECT conv_id, turn, regexp_replace(text, '[\s\x0b]+', '', 'g') AS s, list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda v: v <> '') AS w FROM conversations)""")
def repeated_token_flags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(X.repeats_itself(F.col("text")), F.lit(False)).alias("repeated"))


@query(WITH + V1 + r""" SELECT region_type, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(trim(pred_text, ' '), '^[^\p{L}\p{N}]+$') AND trim(pred_text, ' ') <> trim(ref_text, ' ')) AS drifted FROM (SELECT * REPLACE (CASE WHEN length(pred_text) < 30 THEN regexp_replace(pred_text, '[a-z]', '.', 'g') ELSE pred_text END AS pred_text) FROM v1) GROUP BY 1""")
def punctuation_drift_flags(spark, sf):
    v = V.regions(spark, sf).withColumn("pred_text", F.expr("CASE WHEN length(pred_text) < 30 THEN regexp_replace(pred_text, '[a-z]', '.') ELSE pred_text END"))
    return v.groupBy("region_type").agg(F.count("*").alias("n_rows"), F.count_if(X.punctuation_only(F.col("ref_text"), F.col("pred_text"))).alias("drifted"))


_COUNTS = r"""SELECT {i} AS id, '{t}' AS table_name, length(x) AS n_chars, len(regexp_extract_all(x, '\x{{fffd}}')) AS n_replacement, len(regexp_extract_all(x, '\p{{C}}')) AS n_control, len(regexp_extract_all(x, '[^\x00-\x7F]')) AS n_non_ascii, len(regexp_extract_all(x, '[\x{{0400}}-\x{{04FF}}]')) AS n_cyrillic FROM (SELECT {i}, {c} AS x FROM {t})"""


@query(_COUNTS.format(i="doc_id", t="documents", c="text") + " UNION ALL " + _COUNTS.format(i="page_id", t="pages", c="html"))
def unicode_char_counts(spark, sf):
    one = lambda t, i, c: table(spark, sf, t).select(F.col(i).alias("id"), F.lit(t).alias("table_name"), *(v.alias(k) for k, v in X.code_point_counts(F.col(c)).items()))
    return one("documents", "doc_id", "text").unionByName(one("pages", "page_id", "html"))


@query(WITH + V1 + " SELECT region_id, 'line_' || substr(sha1(page_id || '|' || i || '|(' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ')|' || coalesce(language, '')), 1, 16) AS stable FROM v1")
def stable_ids(spark, sf):
    b = G.box("x1", "y1", "x2", "y2")
    return V.regions(spark, sf).select("region_id", H.stable_id("line", F.col("page_id"), F.col("i"), H.box_text(b), F.col("language")).alias("stable"))


@query(WITH + V1 + """, r AS (SELECT *, 'region_' || substr(sha1(page_id || '|(' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ')|' || region_type || '|' || i), 1, 16) AS id FROM v1)
SELECT page_id, i, id AS region_id, 'ocr_' || substr(sha1(id || '|' || ref_text), 1, 16) AS hypothesis_id, ref_text AS best_text, 'original_image' AS frame, language, legibility FROM r""")
def document_regions(spark, sf):
    r = D.document_region(F.col("page_id"), {"bbox": G.box("x1", "y1", "x2", "y2"), "type": F.col("region_type"), "text": F.col("ref_text"), "language": F.col("language"), "legibility": F.col("legibility")}, F.col("i"))
    made = V.regions(spark, sf).select("page_id", "i", r.alias("r"))
    return made.select("page_id", "i", "r.region_id", F.col("r.ocr_hypotheses")[0]["hypothesis_id"].alias("hypothesis_id"), D.best_text(F.col("r.ocr_hypotheses"), F.col("r.text")).alias("best_text"), F.col("r.source_coordinate.frame").alias("frame"), "r.language", "r.legibility")


_EDIT_SUMS = ", ".join(f"CAST(sum(coalesce({c}, {'n' if c == 'equal' else 0})) AS BIGINT) AS {c}" for c in X.EDITS.names)


def _edit_sums(df: DataFrame) -> DataFrame:
    pairs = df.select("source", X.edit_profile("ref_text", "pred_text").alias("e"))
    return pairs.groupBy("source").agg(*(F.sum(f"e.{c}").alias(c) for c in X.EDITS.names))


@query(REC + V1 + "," + V.EDITS.format(view="v1") + f" SELECT source, {_EDIT_SUMS} FROM v1 LEFT JOIN edits ON ref_text = a AND pred_text = b GROUP BY 1")
def edit_profiles(spark, sf):
    return _edit_sums(V.regions(spark, sf))


@query(REC + V.FAULTY + "," + V.EDITS.format(view="faulty") + f" SELECT source, {_EDIT_SUMS} FROM faulty LEFT JOIN edits ON ref_text = a AND pred_text = b GROUP BY 1")
def faulty_edit_profiles(spark, sf):
    return _edit_sums(V.faulty_run(spark, sf))


def _buckets(view: str, limit: str) -> str:
    """Rows of every label, in SQL: the texts' own faults, then those that follow from the edit counts."""
    share = "CAST({0} AS DOUBLE) / greatest(1, n) >= 0.35 AND {0} > {1} + substitutions"
    return rf""", t AS (SELECT *, regexp_replace(pred_text, '[\s\x0b]+', '', 'g') AS s, list_filter(regexp_split_to_array(pred_text, '[\s\x0b]+'), lambda v: v <> '') AS w FROM {view} LEFT JOIN edits ON ref_text = a AND pred_text = b),
l AS (SELECT source, ref_text <> pred_text AS differs, list_filter([{limit} CASE WHEN trim(pred_text) = '' THEN 'empty_prediction' END, CASE WHEN {_REPEATS} THEN 'repeated_token_degeneration' END,
  CASE WHEN regexp_matches(trim(pred_text, ' '), '^[^\p{{L}}\p{{N}}]+$') AND trim(pred_text, ' ') <> trim(ref_text, ' ') THEN 'punctuation_only_drift' END,
  CASE WHEN contains(pred_text, chr(65533)) THEN 'invalid_unicode_output' END, CASE WHEN contains(ref_text, chr(65533)) THEN 'invalid_unicode_reference' END,
  CASE WHEN cyrillic_substitutions > 0 THEN 'cyrillic_character_confusion' END, CASE WHEN n >= 80 AND length(pred_text) <= greatest(10, floor(n * 0.4)) THEN 'long_line_collapse' END,
  CASE WHEN {share.format("insertions", "deletions")} THEN 'insertion_heavy_failure' END, CASE WHEN {share.format("deletions", "insertions")} THEN 'deletion_heavy_failure' END], lambda x: x IS NOT NULL) AS labels FROM t)
SELECT source, label, count(*) AS n_rows FROM (SELECT source, unnest(CASE WHEN len(labels) > 0 THEN labels WHEN differs THEN ['other_ocr_error'] ELSE ['exact_match'] END) AS label FROM l) GROUP BY 1, 2"""


def _bucket_counts(df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    # every row has a label; explode() would filter for that first and so work all labels out twice
    rows = E.enrich(df.withColumnsRenamed({"ref_text": "reference_text", "pred_text": "predicted_text"}), max_tokens)
    return rows.select("source", F.explode_outer("error_buckets").alias("label")).groupBy("source", "label").agg(F.count("*").alias("n_rows"))


@query(REC + V1 + "," + V.EDITS.format(view="v1") + _buckets("v1", ""))
def error_bucket_counts(spark, sf):
    return _bucket_counts(V.regions(spark, sf).select("source", "ref_text", "pred_text"))


@query(REC + V.FAULTY + "," + V.EDITS.format(view="faulty") + _buckets("faulty", "CASE WHEN token_length > 14 THEN 'truncation_failure' END,"))
def faulty_error_bucket_counts(spark, sf):
    return _bucket_counts(V.faulty_run(spark, sf).select("source", "ref_text", "pred_text", "token_length"), 14)


@query(WITH + V.SCORED + r""", l AS (SELECT *, list_filter([CASE WHEN trim(pred_text) = '' THEN 'empty_prediction' END, CASE WHEN n >= 80 AND length(pred_text) <= greatest(10, floor(n * 0.4)) THEN 'long_line_collapse' END], lambda x: x IS NOT NULL) AS labels FROM sc)
SELECT label, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(labels) > 0 THEN labels WHEN cer > 0 THEN ['other_ocr_error'] ELSE ['exact_match'] END) AS label FROM l) GROUP BY 1""")
def simple_error_labels(spark, sf):
    rows = V.scored(spark, sf).withColumnsRenamed({"ref_text": "reference_text", "pred_text": "predicted_text"})
    keep = F.filter(E.error_labels(profiled=False), lambda x: ~x.isin("repeated_token_degeneration", "punctuation_only_drift"))
    rest = F.when(F.size(keep) > 0, keep).when(F.col("cer") > 0, F.array(F.lit("other_ocr_error"))).otherwise(F.array(F.lit("exact_match")))
    return rows.select(F.explode_outer(rest).alias("label")).groupBy("label").agg(F.count("*").alias("n_rows"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS joined, count(*) AS n_turns FROM conversations GROUP BY 1")
def conversation_turn_order(spark, sf):
    turns = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("turn", "text"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t.text), "\n").alias("joined"), F.count("*").alias("n_turns"))


# ---- input order and open records ----------------------------------------------------------------------------------
@query("SELECT doc_id, row_number() OVER () - 1 AS _row_index FROM documents")
def input_order(spark, sf):
    return O.parquet_in_order(table(spark, sf, "documents")).select("doc_id", "_row_index")


@query(WITH + V1 + """ SELECT split, image_id, region_index, row_number() OVER (PARTITION BY split ORDER BY image_id, region_index) - 1 AS line, ref_text AS text
FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, lpad(CAST(page_id AS VARCHAR), 15, '0') AS image_id, i AS region_index, ref_text FROM v1)""")
def manifest_order(spark, sf):
    """Manifests written in files by range and read again line by line."""
    rows = V.regions(spark, sf).select(F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"), F.lpad(F.col("page_id").cast("string"), 15, "0").alias("image_id"), F.col("i").cast("int").alias("region_index"), F.col("ref_text").alias("text"))
    folder = f"{K.shared_folder(spark)}/pagemill-manifest-{uuid.uuid4().hex}"
    W.write_splits(rows, folder)
    read = lambda split: S_.read_manifest(spark, f"{folder}/split={split}", rows.drop("split").schema, index="line").withColumn("split", F.lit(split))
    back = read("train").unionByName(read("val")) if S_.exists(spark, f"{folder}/split=val") else read("train")
    return back.select("split", "image_id", F.col("region_index").cast("long").alias("region_index"), "line", "text")


@query(WITH + V1 + """ SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'regions' WHEN 1 THEN 'annotations' WHEN 2 THEN 'things' ELSE 'boxes' END AS key, i, CAST(x1 AS DOUBLE) AS x1, CAST(y2 AS DOUBLE) AS y2, region_type AS type, ref_text AS text
FROM v1 WHERE page_id % 5 <> 4 UNION ALL SELECT DISTINCT page_id, NULL, NULL, NULL, NULL, NULL, NULL FROM v1 WHERE page_id % 5 = 4""")
def open_record_regions(spark, sf):
    """Pages as JSON records of five shapes, one of them without a usable box, and the regions found in them by aliases."""
    r = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), F.col("region_type").alias("type"), F.col("ref_text").alias("text"))
    pages = V.regions(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", r.alias("r")))).alias("rs"))  # 24 regions a page at most

    def shape(key: str, *names: str, box=lambda b: b) -> F.Column:
        return F.to_json(F.struct(F.transform("rs", lambda x: F.struct(box(x.r.box).alias(names[0]), x.r.type.alias(names[1]), x.r.text.alias(names[2]))).alias(key)))

    lists = F.to_json(F.struct(*(F.col(f"rs.r.{c}").alias(n) for c, n in (("box", "boxes"), ("type", "types"), ("text", "texts")))))
    kind = F.col("page_id") % 5
    text = F.when(kind == 0, shape("regions", "bbox", "type", "text")).when(kind == 1, shape("annotations", "box", "label", "transcription")).when(kind == 2, shape("things", "bounds", "category", "value"))
    text = text.when(kind == 3, lists).otherwise(shape("regions", "bbox", "type", "text", box=lambda b: b.cast("array<string>")))
    records = pages.select("page_id", text.alias("value")).select("page_id", F.parse_json("value").alias("record"), F.json_object_keys("value").alias("names"))
    found = records.select("page_id", RE.regions_in(F.col("record"), F.col("names")).alias("f")).select("page_id", "f.key", F.posexplode_outer("f.regions").alias("i", "r"))
    return found.select("page_id", "key", F.col("i").cast("long").alias("i"), F.get("r.bbox", F.lit(0)).alias("x1"), F.get("r.bbox", F.lit(3)).alias("y2"), "r.type", "r.text")


# ---- geometry ------------------------------------------------------------------------------------------------------
@query(WITH + V1 + """ SELECT region_id, (x2 - x1) * (y2 - y1) AS area, (y1 + y2) / 2.0 AS y_center, y2 - y1 AS height, greatest(0, x1 - 8) AS px1, least(200, y2 + 8) AS py2, x2 <= 180 AS inside FROM v1""")
def bbox_metrics(spark, sf):
    b = G.box("x1", "y1", "x2", "y2")
    p = G.padded(b, 8, F.lit(400), F.lit(200))
    return V.regions(spark, sf).select("region_id", G.area(b).alias("area"), G.y_center(b).alias("y_center"), G.height(b).cast("long").alias("height"), p.x1.cast("long").alias("px1"), p.y2.cast("long").alias("py2"), G.is_inside(b, F.lit(180), F.lit(100_000)).alias("inside"))


@query(WITH + V.BOXES + f""" SELECT a.page_id, a.region_id AS ref_id, b.region_id AS pred_id, round({IOU.format(a='a', b='b')}, 9) AS iou FROM v1 a JOIN v3 b ON a.page_id = b.page_id WHERE {IOU.format(a='a', b='b')} > 0""")
def iou_pairs(spark, sf):
    pairs = M.overlapping_pairs(V.regions(spark, sf), V.predicted_boxes(spark, sf))
    return pairs.select(F.col("page").alias("page_id"), "ref_id", "pred_id", F.round(G.iou(F.col("ref"), F.col("pred")), 9).alias("iou"))


_SAME = IOU.format(a="q", b="s")


@query(REC + V.CHAINS + f""",
seq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, region_id) AS rn FROM v4),
fold AS (
  SELECT page_id, rn, region_id, CAST(NULL AS BIGINT) AS duplicate_of, [{{'id': region_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': text}}] AS kept FROM seq WHERE rn = 1
  UNION ALL
  SELECT page_id, rn, region_id, CASE WHEN p > 0 THEN kept[p].id END, CASE WHEN p > 0 THEN kept ELSE list_append(kept, {{'id': region_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': text}}) END
  FROM (SELECT s.*, f.kept, coalesce(list_position(list_transform(f.kept, lambda q: q.t = s.text AND ({_SAME}) >= 0.95), true), 0) AS p FROM fold f JOIN seq s ON s.page_id = f.page_id AND s.rn = f.rn + 1))
SELECT page_id, region_id, duplicate_of FROM fold""")
def duplicate_suppression(spark, sf):
    return R.suppress_duplicates(V.chained_boxes(spark, sf)).drop("duplicate_iou")


@query(REC + V.LINES + " SELECT page_id, region_id, line_index, within_line_index, reading_index FROM ordered")
def reading_order(spark, sf):
    return R.order_regions(V.regions(spark, sf).select("page_id", "region_id", *BOX)).withColumns({c: F.col(c).cast("long") for c in ("line_index", "within_line_index", "reading_index")}).drop(*BOX)


@query(REC + V.LINES + """ SELECT page_id, line_index, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_regions, coalesce(string_agg(ref_text, chr(10) ORDER BY within_line_index) FILTER (WHERE ref_text <> ''), '') AS text FROM ordered GROUP BY 1, 2""")
def line_clusters(spark, sf):
    v = V.regions(spark, sf).select("page_id", "region_id", F.col("ref_text").alias("text"), *BOX)
    return R.lines(R.order_regions(v)).drop("region_ids", "line_id").withColumn("line_index", F.col("line_index").cast("long"))


_MATCH = f""",
sides AS (SELECT page_id, list({{'id': region_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY region_id) AS preds FROM v3 GROUP BY page_id),
seq AS (SELECT v.*, preds, row_number() OVER (PARTITION BY v.page_id ORDER BY region_id) AS rn FROM v1 v JOIN sides USING (page_id)),
fold AS (
  SELECT page_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS ref_id, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS DOUBLE) AS iou, CAST([] AS BIGINT[]) AS used FROM sides
  UNION ALL
  SELECT page_id, rn, region_id, CASE WHEN best >= 0.5 THEN preds[list_position(v, best)].id END, CASE WHEN best >= 0.5 THEN best END, CASE WHEN best >= 0.5 THEN list_append(used, preds[list_position(v, best)].id) ELSE used END
  FROM (SELECT *, list_max(v) AS best FROM (SELECT s.page_id, s.rn, s.region_id, s.preds, f.used,
    list_transform(s.preds, lambda q: CASE WHEN list_contains(f.used, q.id) THEN -1.0 ELSE {IOU.format(a='s', b='q')} END) AS v FROM fold f JOIN seq s ON s.page_id = f.page_id AND s.rn = f.rn + 1)))"""


@query(REC + V.BOXES + _MATCH + " SELECT page_id, ref_id, pred_id, round(iou, 9) AS iou FROM fold WHERE pred_id IS NOT NULL")
def greedy_region_match(spark, sf):
    return M.match_regions(V.regions(spark, sf), V.predicted_boxes(spark, sf)).withColumn("iou", F.round("iou", 9))


_COVER = "CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) / ((a.x2 - a.x1) * (a.y2 - a.y1))"
_COVERED = f"cov AS (SELECT a.page_id, a.region_id AS ref_id, b.region_id AS pred_id FROM v1 a JOIN v3 b ON a.page_id = b.page_id WHERE {_COVER} >= 0.35)"
_SPLITS = """SELECT page_id, 'reference_region_split_across_predictions' AS reason, ref_id AS region_id, count(*) AS overlap_count FROM cov GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT page_id, 'predicted_region_merges_references', pred_id, count(*) FROM cov GROUP BY 1, 3 HAVING count(*) > 1"""


@query(WITH + V.BOXES + ", " + _COVERED + "\n" + _SPLITS)
def split_merge_failures(spark, sf):
    return M.split_merge(V.regions(spark, sf), V.predicted_boxes(spark, sf))


@query()  # its parts have SQL (greedy_region_match, split_merge_failures); the whole is tested against a plain model
def failure_attribution(spark, sf):
    ref = V.regions(spark, sf).withColumns({"text": F.col("ref_text"), "reading_index": F.col("i")})
    pred = V.predicted_boxes(spark, sf).withColumns({"text": F.col("pred_text"), "reading_index": F.col("i")})
    counts = M.attribute_failures(ref, pred).groupBy("failure_type").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(k,) for k in ("split_merge_failure", "detection_failure", "overlap_duplicate_failure", "ordering_failure", "ocr_failure")], "failure_type string")
    return kinds.join(counts, "failure_type", "left").select("failure_type", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


@query(REC + V.LINES + """ SELECT page_id || '.jpg' AS image, CAST(count(*) AS BIGINT) AS n_regions, md5(string_agg(CASE WHEN region_type IN ('image', 'graph') THEN '' ELSE pred_text END, chr(10) ORDER BY reading_index)) AS texts_md5 FROM ordered GROUP BY page_id""")
def submission_rows(spark, sf):
    from pagemill.sources.sinks import submission_frame

    v = V.regions(spark, sf).select("page_id", "region_id", "region_type", F.col("pred_text").alias("text"), *BOX)
    rows = submission_frame(R.order_regions(v), F.concat(F.col("page_id").cast("string"), F.lit(".jpg")))
    parsed = F.from_json("regions", "array<struct<bbox:array<int>,type:string,text:string>>")
    return rows.select("image", F.size(parsed).cast("long").alias("n_regions"), F.md5(F.array_join(F.transform(parsed, lambda r: r.text), "\n").cast("binary")).alias("texts_md5"))


# ---- whole plans over the derived pages ----------------------------------------------------------------------------
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The derived regions as annotated pages: one row a page with its regions in order."""
    number = lambda c: F.col(c).cast("double")
    region = F.struct("i", F.array(*map(number, BOX)).alias("bbox"), F.col("region_type").alias("type"), F.col("ref_text").alias("text"), "language", "legibility")
    pages = V.regions(spark, sf).groupBy("page_id").agg(F.any_value("source").alias("source"), F.array_sort(F.collect_list(region)).alias("regions"))
    named = F.format_string("%d.jpg", "page_id")
    return pages.select("page_id", named.alias("file_name"), F.lit(None).cast("string").alias("image_id"), F.lit(None).cast("string").alias("id"), F.lit(400).alias("image_width"), F.lit(200).alias("image_height"), "source", "regions")


_JPG_SPLIT = f"(SELECT page_id, CASE WHEN ({_TERMS}) % 10000 < 2000 THEN 'val' ELSE 'train' END AS split FROM (SELECT page_id, sha256('42:' || page_id || '.jpg') AS d FROM v1 GROUP BY page_id))"
_DECIDED = f"""d AS (SELECT v1.*, split, CASE WHEN ({_REASON}) IS NOT NULL THEN ({_REASON}) WHEN NOT (least(400, x2 + 8) > greatest(0, x1 - 8) AND least(200, y2 + 8) > least(200, greatest(0, y1 - 8))) THEN 'invalid_bbox_after_padding' END AS reason
  FROM v1 JOIN {_JPG_SPLIT} s ON v1.page_id = s.page_id)"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return B.export_decisions(_pages(spark, sf), _FILTER)


@query(WITH + V1 + ",\n" + _DECIDED + " SELECT page_id || '.jpg' AS image_id, i AS region_index, split, coalesce(reason, 'keep') AS reason FROM d")
def export_decisions(spark, sf):
    return _decisions(spark, sf).select("image_id", F.col("region_index").cast("long").alias("region_index"), "split", F.coalesce("reason", F.lit("keep")).alias("reason"))


@query(WITH + V1 + ",\n" + _DECIDED + """ SELECT kind, value, count(*) AS n FROM (
  SELECT 'skipped' AS kind, reason AS value FROM d WHERE reason IS NOT NULL UNION ALL SELECT 'split', split FROM d WHERE reason IS NULL
  UNION ALL SELECT 'region_type', region_type FROM d WHERE reason IS NULL UNION ALL SELECT 'source', coalesce(source, 'unknown') FROM d WHERE reason IS NULL) GROUP BY 1, 2""")
def export_counts(spark, sf):
    return B.export_counts(_decisions(spark, sf))


_EXPORT_COUNTS = SQL["export_counts"]


@query(_EXPORT_COUNTS + """ UNION ALL SELECT 'figures', 'images', count(DISTINCT page_id) FROM d UNION ALL SELECT 'figures', 'regions', count(*) FROM d UNION ALL SELECT 'figures', 'crops', count(*) FROM d WHERE reason IS NULL""")
def export_figures_of_one_pass(spark, sf):
    """The decided regions are written once; totals are observed in that write, counts read what it wrote."""
    rows, seen = P.export_table(_decisions(spark, sf))
    figures = spark.createDataFrame([("figures", k, n) for k, n in seen.items()], "kind string, value string, n long")
    return B.export_counts(rows).unionByName(figures)


@query(WITH + V1 + ",\n" + _DECIDED + """ SELECT printf('%d::r%04d', page_id, i) AS crop_id, printf('crops/%s/%d__r%04d.png', split, page_id, i) AS crop_path, ref_text AS text, region_type, x1, y1, x2, y2 FROM d WHERE reason IS NULL""")
def crop_manifest_rows(spark, sf):
    m = B.crop_manifest(_decisions(spark, sf))
    return m.select("crop_id", "crop_path", "text", "region_type", *(F.get("bbox", F.lit(k)).cast("long").alias(c) for k, c in enumerate(BOX)))


@query(WITH + V1 + """ SELECT page_id, count(*) AS n_regions, count(*) FILTER (WHERE ref_text = '') AS n_empty, max(length(ref_text)) AS longest FROM v1 GROUP BY 1""")
def flat_region_counts(spark, sf):
    from pagemill.sources.readers import flat_regions

    r = flat_regions(_pages(spark, sf))
    return r.groupBy("page_id").agg(F.count("*").alias("n_regions"), F.count_if(F.col("region.text") == "").alias("n_empty"), F.max(F.length("region.text")).cast("long").alias("longest"))


@query(WITH + V1 + """ SELECT source AS split, count(DISTINCT page_id) AS images, count(DISTINCT page_id) AS annotated_images, count(*) AS regions, round(count(*) / count(DISTINCT page_id), 6) AS mean_regions, 400.0::DOUBLE AS mean_width, 200.0::DOUBLE AS mean_height,
  round(sum(n) / count(*), 6) AS mean_text_length, count(*) FILTER (WHERE n = 0) AS empty_text_regions FROM (SELECT * REPLACE (source AS source) FROM v1) GROUP BY 1""")
def page_profile(spark, sf):
    return six(P.data_profile(_pages(spark, sf), "source"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, text = nfc_normalize(text) AS is_nfc FROM documents")
def nfc_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.nfc("text").cast("binary")).alias("nfc_md5"), X.normal_forms("text")["is_nfc"].alias("is_nfc"))


@query("SELECT bucket, count(*) AS n_rows FROM (SELECT CASE WHEN s LIKE '%print%' THEN 'printed' WHEN s LIKE '%hand%' OR s LIKE '%written%' OR s LIKE '%manuscript%' THEN 'handwritten' ELSE 'unknown' END AS bucket FROM (SELECT lower(coalesce(source, 'None') || ' ' || coalesce(text, 'None')) AS s FROM documents)) GROUP BY 1")
def handwriting_buckets(spark, sf):
    return table(spark, sf, "documents").groupBy(X.handwriting_bucket(F.col("source"), F.col("text")).alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("SELECT coalesce(source, '') || '|' || coalesce(lang, '') AS key, count(*) AS n_rows FROM documents GROUP BY 1")
def group_key_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(H.group_key("source", "lang").alias("key")).agg(F.count("*").alias("n_rows"))


def _crops(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("crop_id"), F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"), "source")


_ROWS = r"""crops AS (SELECT CAST(doc_id AS VARCHAR) AS crop_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text, source FROM documents),
rows_ AS (SELECT *, regexp_replace(coalesce(text, ''), '^[\s\x1c-\x1f\x0b]+|[\s\x1c-\x1f\x0b]+$', '', 'g') AS exact_text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS token_length, length(coalesce(text, '')) AS n FROM crops)"""


@query(WITH + _ROWS + f" SELECT crop_id, md5(exact_text) AS text_md5, token_length, n AS raw_text_length, {_BUCKET} AS text_length_bucket FROM rows_")
def annotated_rows(spark, sf):
    return B.annotate(_crops(spark, sf)).select("crop_id", F.md5(F.col("exact_text").cast("binary")).alias("text_md5"), F.col("token_length").cast("long").alias("token_length"), F.col("raw_text_length").cast("long").alias("raw_text_length"), "text_length_bucket")


_PICK = "(SELECT crop_id FROM rows_ WHERE token_length <= {most} {more} ORDER BY sha256('{seed}:' || crop_id), crop_id LIMIT {n})"


@query(WITH + _ROWS + " SELECT 'train' AS split, crop_id FROM " + _PICK.format(most=96, more="", seed=42, n=128) + " UNION ALL SELECT 'val', crop_id FROM " + _PICK.format(most=96, more="", seed=43, n=32))
def smoke_sample(spark, sf):
    train, val = B.smoke_sample(_crops(spark, sf), _crops(spark, sf), 128, 32)
    return train.select(F.lit("train").alias("split"), "crop_id").unionByName(val.select(F.lit("val").alias("split"), "crop_id"))


_OVER = _PICK.format(most=128, more="AND exact_text <> ''", seed=42, n=32)


@query(WITH + _ROWS + f" SELECT 'train' AS split, crop_id FROM {_OVER} UNION ALL SELECT 'val', crop_id FROM (SELECT crop_id FROM {_OVER} ORDER BY sha256('42:' || crop_id), crop_id LIMIT 8)")
def overfit_sample(spark, sf):
    train, val = B.overfit_sample(_crops(spark, sf), 32, 8)
    return train.select(F.lit("train").alias("split"), "crop_id").unionByName(val.select(F.lit("val").alias("split"), "crop_id"))


@query(WITH + _ROWS + " SELECT source, min(token_length) AS min, " + ", ".join(f"round(quantile_cont(token_length, {q}), 6) AS {k}" for k, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", max(token_length) AS max, round(avg(token_length), 6) AS mean FROM rows_ GROUP BY 1")
def token_percentiles(spark, sf):
    rows = B.annotate(_crops(spark, sf)).withColumn("token_length", F.col("token_length").cast("long"))
    return six(rows.groupBy("source").agg(*A.token_percentiles(F.col("token_length"))))


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    """The second run with some keys twice, the later row with another rate."""
    place = F.explode(F.when(F.col("region_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("position")
    rows = V.second_run(spark, sf).select("region_id", "cer", "reference_length", place)
    return rows.withColumn("cer", F.col("cer") + F.col("position"))


@query(WITH + V.SECOND + """, twice AS (SELECT region_id, cer + CASE WHEN region_id % 5 = 0 THEN 1 ELSE 0 END AS cer FROM sc2)
SELECT a.region_id, a.cer AS base_cer, b.cer AS candidate_cer, b.cer - a.cer AS delta FROM sc a JOIN twice b USING (region_id) WHERE b.cer - a.cer > 0 ORDER BY delta DESC, region_id LIMIT 100""")
def last_row_of_each_key_wins(spark, sf):
    base = V.scored(spark, sf).withColumn("position", F.lit(0))
    compared = E.compare_runs(base, _repeated(spark, sf), "region_id", "position")
    return E.largest_changes(compared, 100, True, "region_id").select("region_id", "base_cer", "candidate_cer", "delta")


_FLAGS = _REPEATS.replace("\n", " ")


@query(WITH + V.SCORED + rf""", t AS (SELECT source, cer, n, ref_text, pred_text, regexp_replace(pred_text, '[\s\x0b]+', '', 'g') AS s, list_filter(regexp_split_to_array(pred_text, '[\s\x0b]+'), lambda v: v <> '') AS w FROM sc),
l AS (SELECT source, cer, list_filter([CASE WHEN trim(pred_text) = '' THEN 'empty_prediction' END, CASE WHEN {_FLAGS} THEN 'repeated_token_degeneration' END,
  CASE WHEN regexp_matches(trim(pred_text, ' '), '^[^\p{{L}}\p{{N}}]+$') AND trim(pred_text, ' ') <> trim(ref_text, ' ') THEN 'punctuation_only_drift' END,
  CASE WHEN n >= 80 AND length(pred_text) <= greatest(10, floor(n * 0.4)) THEN 'long_line_collapse' END], lambda x: x IS NOT NULL) AS labels FROM t)
SELECT source, label, count(*) AS n_rows FROM (SELECT source, unnest(CASE WHEN len(labels) > 0 THEN labels WHEN cer > 0 THEN ['other_ocr_error'] ELSE ['exact_match'] END) AS label FROM l) GROUP BY 1, 2""")
def plain_error_labels(spark, sf):
    rows = V.scored(spark, sf).withColumnsRenamed({"ref_text": "reference_text", "pred_text": "predicted_text"})
    return rows.select("source", F.explode_outer(E.error_labels(profiled=False)).alias("label")).groupBy("source", "label").agg(F.count("*").alias("n_rows"))


@query(REC + V.LINES + """, texts AS (SELECT page_id, coalesce(string_agg(ref_text, chr(10) ORDER BY reading_index) FILTER (WHERE ref_text <> '' AND region_type NOT IN ('image', 'graph') AND (language IS NULL OR language = 'uk') AND (legibility IS NULL OR legibility = 'legible')), '') AS t FROM ordered GROUP BY 1)
SELECT page_id, CAST(length(t) AS BIGINT) AS reference_length, CAST(length(t) AS BIGINT) AS edit_distance, CASE WHEN length(t) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS page_cer FROM texts""")
def page_baseline_empty(spark, sf):
    v = V.regions(spark, sf).select("page_id", "region_id", "region_type", "language", "legibility", F.col("ref_text").alias("text"), *BOX)
    return B.page_baseline(v, "empty").select("page_id", "reference_length", "edit_distance", "page_cer")


@query(REC + V.BOXES + _MATCH + """, m AS (SELECT f.page_id, f.ref_id, f.pred_id, a.ref_text, b.pred_text FROM fold f JOIN v1 a ON a.region_id = f.ref_id JOIN v1 b ON b.region_id = f.pred_id WHERE f.pred_id IS NOT NULL)
SELECT 'detection_failure' AS failure_type, count(*) AS n_rows FROM v1 WHERE region_id NOT IN (SELECT ref_id FROM m)
UNION ALL SELECT 'overlap_duplicate_failure', count(*) FROM v3 WHERE region_id NOT IN (SELECT pred_id FROM m)
UNION ALL SELECT 'ocr_failure', count(*) FROM m WHERE ref_text <> pred_text
UNION ALL SELECT 'ordering_failure', count(*) FROM m WHERE ref_id % 100 <> pred_id % 100""")
def failure_counts_by_match(spark, sf):
    return failure_attribution(spark, sf).where("failure_type <> 'split_merge_failure'")


@query(WITH + V.BOXES + """ SELECT a.page_id, count(*) AS n_regions, count(b.region_id) AS n_found, count(*) FILTER (WHERE b.ref_text = a.ref_text) AS n_agree FROM v1 a
  LEFT JOIN (SELECT page_id, x1, y1, x2, y2, max(region_id) AS region_id, max_by(ref_text, region_id) AS ref_text FROM v3 GROUP BY 1, 2, 3, 4, 5) b ON a.page_id = b.page_id AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2 GROUP BY 1""")
def exact_box_lookup(spark, sf):
    text = lambda df: df.select("page_id", "region_id", F.col("ref_text").alias("text"), *BOX)
    found = P.by_box(text(V.regions(spark, sf)), text(V.predicted_boxes(spark, sf)))
    return found.groupBy("page_id").agg(F.count("*").alias("n_regions"), F.count_if("found").alias("n_found"), F.count_if("agrees").alias("n_agree"))


@query(REC + V.LINES + " SELECT page_id, line_index, within_line_index, region_id, ref_text AS text FROM ordered")
def regions_of_lines(spark, sf):
    v = V.regions(spark, sf).select("page_id", "region_id", F.col("ref_text").alias("text"), *BOX)
    made = R.lines(R.order_regions(v)).select("page_id", F.col("line_index").cast("long").alias("line_index"), "region_ids")
    return P.regions_by_id(made, v.select("page_id", "region_id", "text")).withColumn("within_line_index", F.col("within_line_index").cast("long"))


@query(WITH + V.SCORED + " SELECT region_id, cer, reference_length FROM sc ORDER BY cer DESC, reference_length DESC, region_id LIMIT 20")
def rows_to_render(spark, sf):
    rows = V.scored(spark, sf).withColumn("crop_id", F.col("region_id"))
    return P.rows_to_render(rows, "hardest").select("region_id", "cer", "reference_length")


@query(REC + V.LINES + """ SELECT page_id, line_index, 'line_' || substr(sha1(page_id || '|' || line_index || '|(' || min(x1) || ', ' || min(y1) || ', ' || max(x2) || ', ' || max(y2) || ')'), 1, 16) AS line_id, count(*) AS n_regions FROM ordered GROUP BY 1, 2""")
def line_ids(spark, sf):
    v = V.regions(spark, sf).select("page_id", "region_id", F.col("ref_text").alias("text"), *BOX)
    return R.lines(R.order_regions(v)).select("page_id", F.col("line_index").cast("long").alias("line_index"), "line_id", "n_regions")


@query(f"SELECT group_key FROM (SELECT group_key, sha256('42:' || group_key) AS d FROM (SELECT DISTINCT coalesce(source, '') || '|' || coalesce(lang, '') AS group_key FROM documents)) WHERE ({_TERMS}) % 10000 < 2000")
def validation_keys(spark, sf):
    return L.validation_keys(table(spark, sf, "documents"), ["source", "lang"], FRACTION, SEED)


@query("SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS name, count(*) AS n_rows FROM documents GROUP BY 1")
def remapped_names(spark, sf):
    return table(spark, sf, "documents").groupBy(X.remapped(F.col("lang"), {"en": "English", "fr": "French"}).alias("name")).agg(F.count("*").alias("n_rows"))


@query("SELECT doc_id, md5(regexp_replace(nfc_normalize(text), '^[\\s\\x1c-\\x1f\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x1c-\\x1f\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')) AS text_md5 FROM documents")
def decoded_nfc_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.decoded_nfc("text").cast("binary")).alias("text_md5"))


# ---- recognition in batches, data sets, last rows of a stream -----------------------------------------------------------
def _mirror():
    """A reader of which SQL can say what it reads: the image's bytes as text, from the end."""
    return lambda images, texts: [(i.decode()[::-1], float(len(i))) for i in images]


@query(WITH + V1 + """ SELECT region_id, CASE WHEN region_type = 'image' THEN '' ELSE reverse(ref_text) END AS predicted_text, CASE WHEN region_type <> 'image' THEN CAST(n AS DOUBLE) END AS score FROM v1""")
def batched_recognition(spark, sf):
    RG.register("mirror", RG.in_batches(_mirror, budget=4096))
    v = V.regions(spark, sf).select("region_id", "region_type", F.col("ref_text").alias("text"), F.encode("ref_text", "UTF-8").alias("image"))
    return RG.recognize(v, "mirror").select("region_id", "predicted_text", "score")


@query("""SELECT CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS config, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n_rows, round(sum(CASE WHEN lang = 'en' THEN n_chars ELSE n_chars / 2.0 END), 6) AS weight,
  count(*) FILTER (WHERE lang IS DISTINCT FROM 'en' AND source IS NOT NULL) AS n_sources FROM documents GROUP BY 1, 2""")
def data_set_splits(spark, sf):
    """Splits written with columns of their own (a whole number here, a real one and a source there), read back as one frame."""
    root = f"{K.shared_folder(spark)}/pagemill-data-set-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("en"))
    for split, ours in (("val", F.col("doc_id") % 5 == 0), ("train", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))):
        docs.where(ours & F.col("en")).select("doc_id", F.col("n_chars").cast("long").alias("weight")).write.parquet(f"{root}/main/{split}")
        docs.where(ours & ~F.col("en")).select("doc_id", (F.col("n_chars") / 2.0).alias("weight"), "source").write.parquet(f"{root}/other/{split}")
    df = DS.read_data_set(spark, root)
    return df.groupBy("config", "split").agg(F.count("*").alias("n_rows"), F.round(F.sum("weight"), 6).alias("weight"), F.count("source").alias("n_sources"))


@query(WITH + V.SECOND + """, one AS (SELECT doc_id, any_value(source) AS source, sum(edit_distance) AS e, sum(reference_length) AS r FROM sc GROUP BY 1),
two AS (SELECT doc_id, sum(edit_distance) AS e, sum(reference_length) AS r FROM sc2 GROUP BY 1),
l AS (SELECT coalesce(source, '') AS source, coalesce(two.e, one.e) AS e, coalesce(two.r, one.r) AS r FROM one LEFT JOIN two USING (doc_id))
SELECT source, count(*) AS n, CAST(sum(e) AS BIGINT) AS edit_distance, CAST(sum(r) AS BIGINT) AS reference_length, round(CASE WHEN sum(r) > 0 THEN CAST(sum(e) AS DOUBLE) / sum(r) END, 6) AS cer FROM l GROUP BY 1""")
def last_rows_of_a_stream(spark, sf):
    """Sums of each document's regions by two runs, the second over the first, taken in by micro-batches of up to 1,000 files."""
    root = f"{K.shared_folder(spark)}/pagemill-stream-{uuid.uuid4().hex}"
    for k, run in enumerate((V.scored(spark, sf), V.second_run(spark, sf))):
        sums = run.groupBy(F.col("doc_id").cast("string").alias("crop_id")).agg(F.sum("edit_distance").alias("edit_distance"), F.sum("reference_length").alias("reference_length"), F.first("source").alias("text_length_bucket"))
        sums.withColumn("run", F.lit(k).cast("long")).write.mode("append").parquet(f"{root}/in")
    files = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
    SI.run_available(SL.last_row_changes(files, "run"), f"{root}/out", f"{root}/checkpoint")
    rates = SL.current_rates(spark.read.schema(SL.CHANGES).parquet(f"{root}/out"), "text_length_bucket")
    return six(rates.withColumnRenamed("text_length_bucket", "source"))
