"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 6-grams with its bounding blanks, hashed into buckets. A window of `window` words is
the average of its bags' embeddings, and a linear softmax gives its class. A text is judged by its most toxic window, so one
insult in a long text is not averaged away; the whole text is cut into windows, none is left out. Training updates the
embeddings and the softmax together: first on whole-text averages, then on each text's strongest window. Last, the
strongest margin and the log number of windows are calibrated to a probability on a fifth of the sample set aside.

After training, embedding times softmax collapses to one number a bucket (their margin is linear in the average), which is
what is broadcast: 2 ** BITS floats. Misspellings share most character n-grams with the words they come from.

The window of two words is the one of the least log loss in cross_validated() on the learned rows of sf0.1; no held-out row took
part in that choice.

Training is one task of an executor, so it is done again where that is lost. Its sample: ids with a 0/1 label, not held out; up to `toxic_rows` and `other_rows` ids of the two labels in expectation,
chosen by a hash of the id, and of each one text of at most `longest` bytes (an id on several texts gives the one whose hash
is least), so repeated rows add nothing to it. An id with both labels counts as toxic. Only text and label are used. A null
or letterless text has no window and scores 0.0. Without labelled rows of both kinds every score is 0.0. Null ids count as
remainder 0 and are never learned from. Repeated rows score alike; very long texts are scored whole. Columns beside id, text
and label are not read, whatever their names. An empty table gives no rows.
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

BITS, SIZES = 18, (3, 4, 5, 6)
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def subwords(stream: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, the window each lies in, and each text's first window, n + 1."""
    blank = stream == 32
    word = np.cumsum(blank)  # words end with a blank and are numbered by it
    base = word[start[:-1]] if len(start) > 1 else np.zeros(0, np.int64)
    n_words = np.maximum(np.r_[base[1:], word[-1] + 1 if len(word) else 0] - base - 2, 0)
    n_windows = -(-n_words // window)
    first = np.r_[0, np.cumsum(n_windows)]
    ids, where = [], []
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    own = np.minimum((word - base[doc]) // window, np.maximum(n_windows[doc] - 1, 0)) + first[doc] if len(stream) else np.zeros(0, np.int64)
    h = stream * _K[1]
    inner = np.zeros(len(stream) + 1, np.int64)
    np.cumsum(blank, out=inner[1:])
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * _K[0] + stream[n - 1 :] * _K[1] if len(stream) >= n else h[:0]
        if n in SIZES and len(h):
            i = np.arange(len(h))
            ok = inner[i + n - 1] == inner[i + 1]  # no blank strictly inside
            x = h[ok]
            ids.append(((x ^ (x >> np.uint32(15))) * _K[2]) >> np.uint32(32 - BITS))
            where.append(own[i[ok] + 1])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), first
    return np.concatenate(ids), np.concatenate(where), first


@dataclass
class ToxicModel:
    margin: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    length: float = 0.0
    shift: float = 0.0
    window: int = 2

    def strongest(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Largest window margin of every text (0 where it has none) and its number of windows."""
        stream, start, _ = letter_stream(column)
        ids, where, first = subwords(stream, start, self.window)
        n = int(first[-1])
        total, count = np.bincount(where, self.margin[ids], n), np.bincount(where, minlength=n)
        mean = total / np.maximum(count, 1) + self.bias
        windows, best = np.diff(first), np.zeros(len(first) - 1)
        some = np.flatnonzero(windows)
        if len(some):
            best[some] = np.maximum.reduceat(mean, first[:-1][some])
        return best, windows

    def scores(self, column: pa.Array) -> np.ndarray:
        best, windows = self.strongest(column)
        z = self.scale * best + self.length * np.log(np.maximum(windows, 1)) + self.shift
        return np.where(windows > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def train(texts: list[str], labels: list[int], window: int, dim: int, epochs: int, rate: float) -> ToxicModel:
    rng = np.random.default_rng(5)
    table = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    head = ((rng.random((dim, 2)) - 0.5) / dim).astype(np.float32)
    grown, grown_head, bias = np.zeros(1 << BITS, np.float32), np.zeros(2, np.float32), np.zeros(2, np.float32)
    aside = set(range(0, len(texts), 5)) if len(texts) >= 100 else set()
    docs = []
    for text, y in zip(texts, labels, strict=True):
        stream, start, _ = letter_stream(pa.array([text]))
        ids, where, first = subwords(stream, start, window)
        order = np.argsort(where, kind="stable")
        docs.append((y, ids[order].astype(np.uint32), np.searchsorted(where[order], np.arange(first[-1] + 1)).astype(np.uint32)))
        del ids, where, order
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = [0.5 / max(s, 1e-9) for s in share]

    def step(y: int, ids: np.ndarray) -> None:
        nonlocal bias, grown_head, head
        at, c = np.unique(ids, return_counts=True)
        c = (c / len(ids)).astype(np.float32)
        hidden = c @ table[at]
        z = hidden @ head + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        p *= weight[y]
        back = head @ p
        grown[at] += c * c * float(back @ back)
        table[at] -= rate * (c / np.sqrt(grown[at] + 1e-8))[:, None] * back
        grown_head += p * p
        head -= rate * np.outer(hidden, p / np.sqrt(grown_head + 1e-8))
        bias -= rate * p / np.sqrt(grown_head + 1e-8)

    for epoch in range(epochs):
        for k in rng.permutation(len(docs)):
            y, ids, at = docs[k]
            if k in aside or not len(ids):
                continue
            if epoch >= 2 and len(at) > 2:
                margin = table[ids] @ (head[:, 1] - head[:, 0])
                n = np.diff(at)
                mean = np.add.reduceat(margin, at[:-1][n > 0]) / n[n > 0]
                w = np.flatnonzero(n > 0)[mean.argmax()]
                ids = ids[at[w] : at[w + 1]]
            step(y, ids)
    model = ToxicModel((table @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0]), window=window)
    pick = sorted(aside) or range(len(texts))
    best, windows = model.strongest(pa.array([texts[k] for k in pick]))
    x = np.stack([best, np.log(np.maximum(windows, 1)), np.ones(len(best))], 1)
    y = np.array([labels[k] for k in pick], float)
    mean, spread = x[:, :2].mean(0), x[:, :2].std(0) + 1e-9
    x[:, :2] = (x[:, :2] - mean) / spread
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.02, 0.02, 1e-6])
        w += np.linalg.solve(hess, x.T @ (y - p) - np.array([0.02, 0.02, 1e-6]) * w)
    model.scale, model.length = w[0] / spread[0], w[1] / spread[1]
    model.shift = float(w[2] - model.scale * mean[0] - model.length * mean[1])
    return model


def sample_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", modulus: int = 4, held: int = 2, toxic_rows: int = 3000, other_rows: int = 5000, longest: int = 20_000) -> DataFrame | None:
    """(id, text, y) of the sample; None where one of the labels has no row to learn from."""
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.where((remainder("id", modulus) != held) & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(count) < 2:
        return None
    chance = {1: min(1.0, toxic_rows / count[1]), 0: min(1.0, other_rows / count[0])}
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    picked = marks.where(drawn < F.when(F.col("y") == 1, int(chance[1] * (1 << 30))).otherwise(int(chance[0] * (1 << 30))))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= longest)
    one = docs.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    return one.select("id", "r.text", "r.y")


def fit_toxicity(df: DataFrame, labels: DataFrame, window: int = 2, dim: int = 16, epochs: int = 8, rate: float = 0.3, **options) -> ToxicModel | None:
    """The model, trained in one task on the sample that sample_rows draws (with its options); one row of it comes to the driver."""
    rows = sample_rows(df, labels, **options)
    if rows is None:
        return None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("text", pa.string()), ("y", pa.int32())]))])
        texts, y = t.column("text").to_pylist(), t.column("y").to_pylist()
        if len(set(y)) == 2:
            m = train(texts, y, window, dim, epochs, rate)
            yield pa.RecordBatch.from_arrays([pa.array([m.margin.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (m.bias, m.scale, m.length, m.shift))], ["margin", "bias", "scale", "length", "shift"])

    made = rows.repartition(1).sortWithinPartitions("id").mapInArrow(lean(fit), "margin binary, bias double, scale double, length double, shift double").collect()
    return ToxicModel(np.frombuffer(made[0]["margin"], np.float32), *made[0][1:], window) if made else None


def cross_validated(df: DataFrame, labels: DataFrame, windows: tuple[int, ...] = (3, 5, 8, 12, 20), folds: int = 4, dim: int = 16, epochs: int = 8, rate: float = 0.3, threshold: float = 0.3, **options) -> DataFrame | None:
    """How well each window does on rows that may be learned from: one row a window and fold, to choose `window` by.

    The sample of sample_rows (with its options, so no held-out row) is cut into folds by a hash of the text, so equal texts share
    one. A model is trained on the other folds in a task of its own and scores this one: n, toxic, loss (mean log loss),
    found (toxic ones from the threshold on), alarms (others). A fold whose rest lacks one of the labels gives no row.
    """
    rows = sample_rows(df, labels, **options)
    if rows is None:
        return None
    tried = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.lit(k).alias("fold")) for w in windows for k in range(folds))))
    own = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(folds)).cast("int")
    runs = rows.withColumn("own", own).withColumn("run", tried).select("id", "text", "y", "own", "run.*")

    def judge(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        window, fold = t.column("window")[0].as_py(), t.column("fold")[0].as_py()
        inside = np.asarray(t.column("own")) == fold
        texts, y = t.column("text").to_pylist(), np.asarray(t.column("y"))
        out = []
        if len(set(y[~inside].tolist())) == 2 and inside.any():
            model = train([x for x, i in zip(texts, inside, strict=True) if not i], y[~inside].tolist(), window, dim, epochs, rate)
            s, truth = model.scores(pa.array([x for x, i in zip(texts, inside, strict=True) if i], pa.string())), y[inside]
            p = np.clip(np.where(truth == 1, s, 1 - s), 1e-6, 1)
            out = [{"window": window, "fold": fold, "n": len(s), "toxic": int(truth.sum()), "loss": float(-np.log(p).mean()), "found": int((s[truth == 1] >= threshold).sum()), "alarms": int((s[truth == 0] >= threshold).sum())}]
        return pa.Table.from_pylist(out, pa.schema([("window", pa.int32()), ("fold", pa.int32()), ("n", pa.int64()), ("toxic", pa.int64()), ("loss", pa.float64()), ("found", pa.int64()), ("alarms", pa.int64())]))

    return runs.repartition(len(windows) * folds, "window", "fold").groupBy("window", "fold").applyInArrow(judge, "window int, fold int, n long, toxic long, loss double, found long, alarms long")


def score_toxicity(df: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    docs = df.select(F.col(id_col).cast("long").alias(id_col), (remainder(F.col(id_col).cast("long"), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.scores(b.column("text")) if shared.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.mapInArrow(lean(run), f"`{id_col}` long, held_out boolean, score double, predicted int")
