"""Annotated pages derived from documents: every character of every text lies in one region.

A region is a piece of up to 80 characters of a line, a page 24 regions on end. Boxes, types and a corrupted prediction
follow from positions and lengths, so the same rows can be written down in plain SQL. Characters beyond ASCII are `?` so
that engines which count bytes and engines which count code points agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import edit_distance, error_rate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of fewer splits than cores to all cores; a larger input keeps its splits and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `?` for what is not ASCII before the cut: one expression a text, and a filter on the pieces repeats nothing
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    # by a pattern, which reads a line once; substring() would count from the line's start for every piece
    cut = lambda line: F.when(line == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(line, F.lit("(?s).{1,80}"), F.lit(0)))
    pieces = F.flatten(F.transform(F.split(ascii_, "\n", -1), cut))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.posexplode(pieces).alias("region_index", "ref_text"))
    rows = rows.selectExpr("doc_id", "source", "lang", "cast(region_index as bigint) AS region_index", "doc_id * 100000 + region_index div 24 AS page_id", "cast(region_index % 24 as bigint) AS i", "ref_text")
    rows = rows.withColumn("n", F.length("ref_text").cast("long"))
    return rows.selectExpr(
        "*",
        "page_id * 100 + i AS region_id",
        "CASE WHEN (doc_id + region_index) % 3 <> 0 THEN translate(ref_text, 'aeiou', 'eioua') ELSE ref_text END AS pred_text",
        "CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN 'de' ELSE 'uk' END AS language",
        "CASE region_index % 5 WHEN 3 THEN 'formula' WHEN 4 THEN 'image' WHEN 1 THEN 'printed' ELSE 'handwritten' END AS region_type",
        "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 6 THEN 'illegible' ELSE 'legible' END AS legibility",
        "(i % 3) * 100 AS x1",
        "(i div 3) * 20 + n % 7 AS y1",
        "(i % 3) * 100 + 10 + n % 80 AS x2",
        "(i div 3) * 20 + n % 7 + 12 + n % 9 AS y2",
    )


def _rated(rows: DataFrame) -> DataFrame:
    """The distance once a row; its rate follows from it."""
    rows = rows.withColumns({"edit_distance": edit_distance(F.col("ref_text"), F.col("pred_text")), "reference_length": F.col("n")})
    return rows.withColumn("cer", error_rate(F.col("ref_text"), F.col("pred_text"), F.col("edit_distance")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(regions(spark, sf_dir))


def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another recogniser, which gives no row for blank regions."""
    rows = regions(spark, sf_dir).where("ref_text <> ''").withColumn("pred_text", F.expr("CASE WHEN (doc_id + region_index) % 4 = 0 THEN translate(ref_text, 'tnsr', 'nsrt') ELSE ref_text END"))
    return _rated(rows)


def faulty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third recogniser with every kind of fault: nothing, halves, doubles, replacement characters, dots, Cyrillic vowels mixed up."""
    rows = regions(spark, sf_dir).withColumn("kind", F.expr("(doc_id + region_index) % 8"))
    rows = rows.withColumn("ref_text", F.expr("CASE kind WHEN 1 THEN translate(ref_text, 'aeiou', 'аеіоу') WHEN 2 THEN concat(ref_text, '\ufffd') ELSE ref_text END"))
    pred = """CASE kind WHEN 0 THEN '' WHEN 1 THEN translate(ref_text, 'аеіоу', 'еіоуа') WHEN 3 THEN substring(ref_text, 1, cast(n * 3 div 10 as int)) WHEN 4 THEN concat(ref_text, reverse(ref_text))
      WHEN 5 THEN concat('\ufffd', ref_text) WHEN 6 THEN regexp_replace(ref_text, '[a-zA-Z0-9?]', '.') ELSE ref_text END"""
    return rows.withColumn("pred_text", F.expr(pred)).withColumn("n", F.length("ref_text").cast("long")).withColumn("token_length", F.size(F.split("ref_text", " ", -1)).cast("long"))


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes shifted to the right and some grown downwards by position; blank regions are not found."""
    return regions(spark, sf_dir).where("ref_text <> ''").withColumns({"x1": F.expr("x1 + (i % 4) * 3"), "x2": F.expr("x2 + (i % 4) * 3"), "y2": F.expr("y2 + CASE WHEN i % 3 = 2 THEN (i % 4) * 8 ELSE 0 END")})


def chained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of which some have two copies, each a little wider: neighbours are near duplicates, ends may not be."""
    w = "(x2 - x1)"
    copies = F.expr(f"CASE WHEN i % 2 = 0 AND {w} >= 25 THEN array(0L, 1L, 2L) ELSE array(0L) END")
    return regions(spark, sf_dir).withColumn("c", F.explode(copies)).selectExpr("page_id", "region_id * 3 + c AS region_id", "x1", "y1", f"x2 + c * ({w} div 25) AS x2", "y2", "ref_text AS text")


V1 = r"""
pieces AS (SELECT doc_id, lang, source, flatten(list_transform(string_split(text, chr(10)), lambda l:
  list_transform(range(0, greatest(0, (length(l) - 1) // 80) + 1), lambda k: substring(l, k * 80 + 1, 80)))) AS p FROM documents),
raws AS (SELECT doc_id, lang, source, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS region_index, unnest(p) AS raw FROM pieces),
refs AS (SELECT doc_id, source, lang, region_index, doc_id * 100000 + region_index // 24 AS page_id, region_index % 24 AS i,
  regexp_replace(raw, '[^\x00-\x7F]', '?', 'g') AS ref_text FROM raws),
v1 AS (SELECT *, page_id * 100 + i AS region_id,
  CASE WHEN (doc_id + region_index) % 3 <> 0 THEN translate(ref_text, 'aeiou', 'eioua') ELSE ref_text END AS pred_text,
  CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN 'de' ELSE 'uk' END AS language,
  CASE region_index % 5 WHEN 3 THEN 'formula' WHEN 4 THEN 'image' WHEN 1 THEN 'printed' ELSE 'handwritten' END AS region_type,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 6 THEN 'illegible' ELSE 'legible' END AS legibility,
  (i % 3) * 100 AS x1, (i // 3) * 20 + n % 7 AS y1, (i % 3) * 100 + 10 + n % 80 AS x2, (i // 3) * 20 + n % 7 + 12 + n % 9 AS y2
  FROM (SELECT *, CAST(length(ref_text) AS BIGINT) AS n FROM refs))"""


def _rates(source: str) -> str:
    return f"""SELECT *, CAST(levenshtein(ref_text, pred_text) AS BIGINT) AS edit_distance, n AS reference_length,
  CASE WHEN n > 0 THEN CAST(levenshtein(ref_text, pred_text) AS DOUBLE) / n WHEN length(pred_text) > 0 THEN 1.0 ELSE 0.0 END AS cer FROM {source}"""


#: Edit counts of each unequal pair of texts (a, b) of a view: runs of equal characters on diagonals, cut level by level by the longest of each part.
EDITS = r"""
texts AS (SELECT row_number() OVER () AS p, * FROM (SELECT DISTINCT ref_text AS a, pred_text AS b FROM {view} WHERE ref_text <> pred_text)),
ones AS (SELECT p, unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) - 1 AS i FROM texts WHERE a <> ''),
twos AS (SELECT p, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) - 1 AS j FROM texts WHERE b <> ''),
cells AS (SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS run FROM ones JOIN twos USING (p, c)),
parts AS (
  SELECT p, 0 AS depth, 0::BIGINT AS alo, 0::BIGINT AS blo, min(i) AS i, min(j) AS j, count(*) AS size FROM cells GROUP BY p, i - j, run
  UNION ALL
  SELECT p, depth + 1, CASE WHEN side = 0 THEN alo ELSE bi + bs END, CASE WHEN side = 0 THEN blo ELSE bj + bs END,
    CASE WHEN side = 0 THEN i ELSE i + skip END, CASE WHEN side = 0 THEN j ELSE j + skip END, CASE WHEN side = 0 THEN before ELSE size - skip END
  FROM (SELECT *, least(size, bi - i, bj - j) AS before, greatest(bi + bs - i, bj + bs - j, 0) AS skip, unnest([0, 1]) AS side
    FROM (SELECT *, (best // 1000000) AS bs, 999 - (best // 1000) % 1000 AS bi, 999 - best % 1000 AS bj
      FROM (SELECT *, max(size * 1000000 + (999 - i) * 1000 + 999 - j) OVER (PARTITION BY p, alo, blo) AS best FROM parts)))
  WHERE CASE WHEN side = 0 THEN before > 0 ELSE size > skip END),
blocks AS (SELECT p, 999 - (best // 1000) % 1000 AS i, 999 - best % 1000 AS j, best // 1000000 AS size
  FROM (SELECT p, max(size * 1000000 + (999 - i) * 1000 + 999 - j) AS best FROM parts GROUP BY p, depth, alo, blo)),
gaps AS (SELECT p, a, b, size, i - coalesce(lag(i + size) OVER o, 0) AS lost, j - coalesce(lag(j + size) OVER o, 0) AS new, coalesce(lag(i + size) OVER o, 0) AS ai, coalesce(lag(j + size) OVER o, 0) AS bj
  FROM (SELECT p, i, j, size FROM blocks UNION ALL SELECT p, length(a), length(b), 0 FROM texts) JOIN texts USING (p) WINDOW o AS (PARTITION BY p ORDER BY i, j, size DESC)),
edits AS (SELECT a, b, sum(CASE WHEN lost = 0 THEN new ELSE 0 END) AS insertions, sum(CASE WHEN new = 0 THEN lost ELSE 0 END) AS deletions,
  sum(CASE WHEN lost > 0 AND new > 0 THEN greatest(lost, new) ELSE 0 END) AS substitutions, sum(size) AS equal,
  sum(CASE WHEN lost > 0 AND new > 0 THEN len(list_filter(range(1, least(lost, new) + 1), lambda k: substring(a, ai + k, 1) <> substring(b, bj + k, 1) AND regexp_matches(substring(a, ai + k, 1), '[\x{{0400}}-\x{{04FF}}]') AND regexp_matches(substring(b, bj + k, 1), '[\x{{0400}}-\x{{04FF}}]'))) ELSE 0 END) AS cyrillic_substitutions
  FROM gaps GROUP BY p, a, b)"""
SCORED = V1 + f",\nsc AS ({_rates('v1')})"
SECOND = (
    SCORED
    + ",\nb1 AS (SELECT * REPLACE (CASE WHEN (doc_id + region_index) % 4 = 0 THEN translate(ref_text, 'tnsr', 'nsrt') ELSE ref_text END AS pred_text) FROM v1 WHERE ref_text <> ''),"
    + f"\nsc2 AS ({_rates('b1')})"
)
FAULTY = V1 + r""",
kinds AS (SELECT * REPLACE (CASE kind WHEN 1 THEN translate(ref_text, 'aeiou', 'аеіоу') WHEN 2 THEN ref_text || chr(65533) ELSE ref_text END AS ref_text) FROM (SELECT *, (doc_id + region_index) % 8 AS kind FROM v1)),
preds AS (SELECT * REPLACE (CASE kind WHEN 0 THEN '' WHEN 1 THEN translate(ref_text, 'аеіоу', 'еіоуа') WHEN 3 THEN substring(ref_text, 1, CAST(n * 3 // 10 AS INT)) WHEN 4 THEN ref_text || reverse(ref_text)
  WHEN 5 THEN chr(65533) || ref_text WHEN 6 THEN regexp_replace(ref_text, '[a-zA-Z0-9?]', '.', 'g') ELSE ref_text END AS pred_text) FROM kinds),
faulty AS (SELECT * REPLACE (CAST(length(ref_text) AS BIGINT) AS n), len(string_split(ref_text, ' ')) AS token_length FROM preds)"""
BOXES = V1 + ",\nv3 AS (SELECT * REPLACE (x1 + (i % 4) * 3 AS x1, x2 + (i % 4) * 3 AS x2, y2 + CASE WHEN i % 3 = 2 THEN (i % 4) * 8 ELSE 0 END AS y2) FROM v1 WHERE ref_text <> '')"
CHAINS = V1 + r""",
v4 AS (SELECT page_id, region_id * 3 + c AS region_id, x1, y1, x2 + c * ((x2 - x1) // 25) AS x2, y2, ref_text AS text
  FROM (SELECT *, unnest(CASE WHEN i % 2 = 0 AND x2 - x1 >= 25 THEN [0, 1, 2] ELSE [0] END) AS c FROM v1))"""
#: Leader fold over the regions of a page; line numbers from 1.
LINES = V1 + r""",
seq AS (SELECT *, (y1 + y2) / 2.0 AS cy, greatest(1, y2 - y1) AS h, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, x2, region_id) AS rn FROM v1),
fold AS (
  SELECT page_id, rn, region_id, CAST(1 AS BIGINT) AS line, [{'c': cy, 'h': h}] AS anchors FROM seq WHERE rn = 1
  UNION ALL
  SELECT page_id, rn, region_id, CASE WHEN p > 0 THEN p ELSE len(anchors) + 1 END, CASE WHEN p > 0 THEN anchors ELSE list_append(anchors, {'c': cy, 'h': h}) END
  FROM (SELECT s.page_id, s.rn, s.region_id, s.cy, s.h, f.anchors,
    coalesce(list_position(list_transform(f.anchors, lambda q: abs(q.c - s.cy) <= 0.5 * greatest(q.h, s.h)), true), 0) AS p
    FROM fold f JOIN seq s ON s.page_id = f.page_id AND s.rn = f.rn + 1)),
ordered AS (SELECT v.*, f.line - 1 AS line_index,
  row_number() OVER (PARTITION BY v.page_id, f.line ORDER BY x1, y1, x2, v.region_id) - 1 AS within_line_index,
  row_number() OVER (PARTITION BY v.page_id ORDER BY f.line, x1, y1, x2, v.region_id) - 1 AS reading_index
  FROM v1 v JOIN fold f ON v.page_id = f.page_id AND v.region_id = f.region_id)"""
IOU = """CASE WHEN greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) > 0 THEN
  CAST(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) AS DOUBLE) /
  (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) ELSE 0.0 END"""
