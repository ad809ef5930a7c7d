"""Language ID: sparse multinomial logistic regression on TF-IDF of character 1-, 2- and 3-grams, hashed.

Document frequencies come from all labelled rows that are not held out. The weights are fitted by follow-the-regularised-
leader with elastic-net penalties (L1 leaves most weights at zero), one row at a time, on a bounded sample of the distinct
labelled texts (`sample` of them in expectation, chosen by a hash of the text, each of at most `longest` bytes). Every
labelled language has an equal share of the sample, or all its texts if they are fewer, LEAST_ROWS in expectation in any
case; one that has longer texts only gives up to LONG_ROWS of these. A text that repeats counts once, also in the (sketched)
numbers of texts by which the shares are set. Every fifth text of a
language is set aside to fit the temperature by which all logits are divided: the least log loss against targets that are
smoothed by one pseudo-row a language, so that it has a minimum even where every text is told rightly. Prediction runs over
whole texts in Arrow batches with the weights broadcast (buckets * languages floats, a fixed bound).

Only text and label are used; the label only of rows that are not held out. `und` with score 0.0 is given where a text is
null or has no letter, and to all rows if no row is labelled. Null ids count as remainder 0, rows with a null text or label are
not learned from. Of languages with equal probability the first by name is given. Repeated rows are predicted alike. Very long
texts are counted whole. Columns beside id, text and label are not read by predict_languages and are handed through by
identified, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, remainder, slices
from pagemill.llm.letters import letter_stream

BITS = 15
LEAST_ROWS, LONG_ROWS = 20, 64
TEMPERATURES = np.geomspace(0.002, 100, 241)
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _buckets(stream: np.ndarray) -> list[np.ndarray]:
    out, h = [], np.zeros(len(stream), np.uint32)
    for n in (1, 2, 3):
        h = h[: max(0, len(stream) - n + 1)] * _K[0] + stream[n - 1 :] * _K[1]
        x = h ^ (h >> np.uint32(15))
        out.append((x * _K[2]) >> np.uint32(32 - BITS))
    return out


def gram_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Buckets and counts of every text in turn, None where it has no letter."""
    stream, start, has = letter_stream(column)
    grams = _buckets(stream)
    for k, ok in enumerate(has.tolist()):
        if not ok:
            yield None
            continue
        a, b = start[k], start[k + 1]
        c = sum(np.bincount(g[a : b - n], minlength=1 << BITS) for n, g in enumerate(grams))
        at = np.flatnonzero(c)
        yield at, c[at]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = np.log1p(c) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def probabilities(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = (self.vector(at, c) @ self.weights[at]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], model: LanguageModel, epochs: int, alpha: float, l1: float, l2: float) -> None:
    """Follow the regularised leader, per coordinate, over (label, buckets, values)."""
    k = len(model.langs)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    leader = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, at, x = rows[r]
            w = leader(z[at], n[at])
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    model.weights = leader(z, n)


def fit_temperature(rows: list[tuple[int, np.ndarray]]) -> float:
    """The divisor of logits with least log loss over (label, logits), on a grid; targets smoothed by one row a class."""
    if not rows:
        return 1.0
    y, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n, k = z.shape
    target = np.full((n, k), 1.0 / (n + k))
    target[np.arange(n), y] = (n + 1.0) / (n + k)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - (s * target).sum(1)).mean())

    return float(min(TEMPERATURES, key=loss))


def fair_share(counts: list[int], sample: int) -> float:
    """The number of rows to draw of each language (all, where it has fewer), so that `sample` are drawn; at least LEAST_ROWS."""
    left = float(sample)
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(LEAST_ROWS, left / (len(counts) - k))
        left -= n
    return float(max(counts, default=0))


def fit_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, sample: int = 3000, longest: int = 20_000, epochs: int = 4, alpha: float = 0.5, l1: float = 0.1, l2: float = 1e-3) -> LanguageModel | None:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((remainder("id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.octet_length("text") <= longest
    found = {r["lang"]: (r["short"], r["long"]) for r in rows.groupBy("lang").agg(*(F.approx_count_distinct(F.when(c, F.xxhash64("text"))).alias(n) for c, n in ((short, "short"), (~short, "long")))).collect()}
    if not found:
        return None
    level = fair_share([x or y for x, y in found.values()], sample)
    share = {lang: min(1.0, level / x if x else min(level, LONG_ROWS) / y) for lang, (x, y) in found.items()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in slices(batches):
            for got in gram_counts(b.column("text")):
                if got:
                    seen[got[0]] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["seen", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for x, k in zip(b.column("seen").to_pylist(), b.column("n").to_pylist(), strict=True):
                seen, n = seen + np.frombuffer(x, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["seen", "n"])

    kind = "seen binary, n long"
    table = rows.select("text").mapInArrow(lean(frequencies), kind).repartition(32).mapInArrow(lean(added), kind).collect()
    seen, n = sum(np.frombuffer(r["seen"], np.int64) for r in table), sum(r["n"] for r in table)
    idf = np.log((1 + n) / (1 + seen)) + 0.1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [(h, lang, *x) for h, lang, x in zip(b.column("h").to_pylist(), b.column("lang").to_pylist(), gram_counts(b.column("text")), strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2].astype(np.uint16).tobytes() for g in got], pa.binary()), pa.array([np.minimum(g[3], 65_535).astype(np.uint16).tobytes() for g in got], pa.binary())], ["h", "lang", "at", "c"])

    shares = df.sparkSession.createDataFrame([(lang, x == 0, int(share[lang] * (1 << 30))) for lang, (x, _) in found.items()], "lang string, only_long boolean, below long")
    drawn = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(shares), "lang").where((short | F.col("only_long")) & (F.pmod("h", F.lit(1 << 30)) < F.col("below")))
    # however often a text repeats, it is one row of the sample; the limit is never reached but by chance of the hash
    chosen = drawn.groupBy("h", "lang").agg(F.min("text").alias("text")).orderBy("h", "lang").limit(2 * sample + (LEAST_ROWS + LONG_ROWS) * len(found))
    got = sorted(map(tuple, chosen.mapInArrow(lean(features), "h long, lang string, at binary, c binary").collect()))
    langs = sorted({r[1] for r in got})
    if not langs:
        return None
    model = LanguageModel(langs, np.zeros((1 << BITS, len(langs))), idf)
    rows_ = []
    for _, lang, at, c in got:
        at, c = np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(c, np.uint16).astype(np.float64)
        rows_.append((langs.index(lang), at, model.vector(at, c)))
    aside, learned, seen_ = [], [], [0] * len(langs)
    for r in rows_:  # every fifth row of a language
        seen_[r[0]] += 1
        (aside if len(rows_) >= 50 and seen_[r[0]] % 5 == 0 else learned).append(r)
    fit_ftrl(learned, model, epochs, alpha, l1, l2)
    model.temperature = fit_temperature([(y, x @ model.weights[at]) for y, at, x in aside])
    return model


def predict_languages(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    docs = df.select(F.col(id_col).cast("long").alias(id_col), (remainder(F.col(id_col).cast("long"), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = predictions(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return docs.mapInArrow(lean(predict), f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def predictions(model: LanguageModel | None, column: pa.Array) -> tuple[list[str], list[float]]:
    lang, score = [], []
    for got in gram_counts(column):
        if got is None or model is None:
            lang.append("und")
            score.append(0.0)
        else:
            p = model.probabilities(*got)
            lang.append(model.langs[int(p.argmax())])
            score.append(float(p.max()))
    return lang, score


def identified(df: DataFrame, model: LanguageModel | None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of df, all columns as they are, whose text has a language with at least this score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            lang, score = predictions(shared.value, b.column(text_col))
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return df.mapInArrow(lean(keep), df.schema)
