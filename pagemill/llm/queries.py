"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.alignment import align_tokenizers
from pagemill.llm.ann import nearest
from pagemill.llm.decontam import benchmark_overlaps
from pagemill.llm.importance import importance_resample
from pagemill.llm.langid import fit_languages, predict_languages
from pagemill.llm.media import media_columns
from pagemill.llm.mixing import mix_sources
from pagemill.llm.ngram_join import ngram_jaccard_components
from pagemill.llm.sharding import shard_documents
from pagemill.llm.suffix_lm import suffix_tree_scores
from pagemill.llm.token_counts import encoded_lengths, length_histogram
from pagemill.llm.toxicity import fit_toxicity, score_toxicity
from pagemill.llm.warc import derivatives, responses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op2_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op5_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumn("p", F.round("p", 9)).drop("copies", "key")


def op9_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), keep_groups=False)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_vector_bin_packing, op3_token_length_histogram, op4_suffix_tree_scores, op5_spaced_seed_overlaps, op6_warc_derivatives, op7_language_id, op8_pareto_mix, op9_wav_fingerprints, op10_subword_toxicity, op11_importance_resampling, op12_additive_quantisation, op13_tokenizer_alignment)}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM low)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * both_ >= 75 * (u.n + v.n - both_)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)""",
    "op8_pareto_mix": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM sources),
run AS (
  SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS ws,
    coalesce(sum(cap) OVER o, 0) AS c0, coalesce(sum(w) OVER o, 0) AS w0 FROM weighed
  WINDOW o AS (ORDER BY cap / w ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * (ws - w0) <= w * (t - c0) AS capped FROM run),
levels AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS cc, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS cw FROM flagged),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (t - cc) AS DOUBLE) / CAST(ws - cw AS DOUBLE) END AS target FROM levels),
factored AS (SELECT *, 1 + (length(bin(size)) - 1) / 8.0::DOUBLE AS factor FROM docs),
amounts AS (
  SELECT f.source, factor, target, CAST(sum(size) AS BIGINT) AS words FROM factored f JOIN targets t ON f.source IS NOT DISTINCT FROM t.source
  GROUP BY f.source, factor, target HAVING sum(size) > 0),
weighted AS (SELECT *, CAST(3 * words AS DOUBLE) AS cap, factor * words AS w FROM amounts),
run2 AS (
  SELECT *, sum(w) OVER (PARTITION BY source) AS ws, coalesce(sum(cap) OVER o, 0) AS c0, coalesce(sum(w) OVER o, 0) AS w0 FROM weighted
  WINDOW o AS (PARTITION BY source ORDER BY cap / w ASC, factor DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged2 AS (SELECT *, cap * (ws - w0) <= w * (target - c0) AS capped FROM run2),
levels2 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (PARTITION BY source), 0) AS cc, coalesce(sum(CASE WHEN capped THEN w END) OVER (PARTITION BY source), 0) AS cw FROM flagged2),
copied AS (SELECT *, CASE WHEN capped THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, factor * ((target - cc) / (ws - cw))) END AS expected FROM levels2),
split AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM copied),
owed AS (SELECT source, factor, whole, p, target - CAST(sum(whole * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM split),
parts AS (
  SELECT d.*, source_size, target, whole, p, rest, (CAST(CAST('0x' || substr(key, 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u, CAST(size * 64 AS DOUBLE) > rest AS big
  FROM factored d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN owed o ON d.source IS NOT DISTINCT FROM o.source AND d.factor = o.factor),
ordered AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM parts),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source, big, rank IS NULL ORDER BY rank, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered),
hoped AS (SELECT source, sum(p * words) AS hoped FROM (SELECT source, p, sum(size) AS words FROM summed WHERE big AND rank IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
large AS (SELECT s.*, CASE WHEN CAST(2 * upto - size AS DOUBLE) <= 2 * hoped THEN 1 ELSE 0 END AS extra FROM summed s JOIN hoped h ON s.source IS NOT DISTINCT FROM h.source WHERE big AND rank IS NOT NULL),
got AS (SELECT source, sum(extra * size) AS got FROM large GROUP BY 1),
decided AS (
  SELECT * FROM large
  UNION ALL SELECT s.*, CASE WHEN CAST(2 * upto - size AS DOUBLE) <= 2 * (rest - CAST(coalesce(got, 0) AS DOUBLE)) THEN 1 ELSE 0 END AS extra
    FROM summed s LEFT JOIN got g ON s.source IS NOT DISTINCT FROM g.source WHERE NOT big AND rank IS NOT NULL),
gaps AS (SELECT source, any_value(rest) - CAST(sum(extra * size) AS DOUBLE) AS gap FROM decided GROUP BY 1),
late AS (SELECT doc_id, gap, size, sum(size) OVER (PARTITION BY d.source ORDER BY rank, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_
  FROM decided d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source WHERE extra = 0 AND CAST(size AS DOUBLE) <= gap),
last AS (SELECT doc_id FROM late WHERE CAST(2 * after_ - size AS DOUBLE) <= 2 * gap)
SELECT doc_id, source, size, source_size, target, CAST((coalesce(whole, 0) + CASE WHEN doc_id IN (SELECT doc_id FROM last) THEN 1 ELSE extra END) * size AS BIGINT) AS taken, round(coalesce(p, 0), 9) AS p
FROM (SELECT doc_id, source, size, source_size, target, whole, p, extra FROM decided UNION ALL SELECT doc_id, source, size, source_size, target, whole, p, 0 FROM summed WHERE rank IS NULL)""",
    "op11_importance_resampling": r"""
WITH steps AS (
  SELECT list(c ORDER BY v) AS t FROM (
    SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(v))),
words AS (
  SELECT corpus, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
runs AS (
  SELECT corpus, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT corpus, id, f, count(*) AS n FROM runs GROUP BY ALL),
names AS (SELECT DISTINCT f FROM counted),
bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, steps),
totals AS (SELECT sum(n) FILTER (corpus = 's') AS big_s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS big_t FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln(CAST((t + 1) * (big_s + 10000) AS DOUBLE) / CAST((s + 1) * (big_t + 10000) AS DOUBLE))) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (corpus = 's'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM counted JOIN bucketed USING (f) GROUP BY bucket), totals),
weights AS (
  SELECT id, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE corpus = 's' GROUP BY id),
scored AS (
  SELECT id AS doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE corpus = 's'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 25 // 100 AS draws FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= draws THEN r END AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
}
