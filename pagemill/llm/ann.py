"""Approximate nearest neighbours by additive quantisation: largest inner products, reranked exactly.

A vector is its norm times a direction, and a direction is coded as a sum of one codeword from each of `books` full-dimensional codebooks.
Codebooks start as k-means of what the books before left over (a residual) and are then refitted together by least squares
between rounds of encoding. Encoding is a beam search over the books: the `beam` best sums so far are extended by every codeword. Codes and norms are stored. A query has one table of products per book; a candidate's
score is its norm times the sum of its codewords' entries; the `pool` best of each part of the candidates are reranked with the
original vectors in double precision, and the parts' best are merged by query.

The codebooks are fitted in one task on `sample` distinct vectors at most, taken by a hash; every vector is coded and searched.
Vectors that are equal are one candidate with its `top` + 1 smallest ids, which is all that any result can hold of them: ties go to
smaller ids and a query leaves out only its own. The candidates are dealt into parts of at most some `part_rows` and every
block of queries meets every part, so work grows with queries times candidates and a task holds one part and one block.

Null, empty and zero vectors and those with null or non-finite components take no part, nor do null ids, nor vectors of another
length than the most frequent one. Repeated rows of an id and a vector count once; an id on several vectors is one query and one
candidate, by the largest product of any of them, and a query leaves out all rows of its id. A product that is not a number does not count. Columns beside id and vector are not read, whatever their names.
An empty table gives no rows; with fewer than `top` candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import lean, stored, task_keys

QUERIES_A_BLOCK = 256


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The rows of x added by at, k sums."""
    return np.stack([np.bincount(at, column, k) for column in x.T], 1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of x by k-means; a centre that loses all takes a random vector."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, _sums(x, near, k) / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(x.dtype)
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4, rows: int = 1024) -> np.ndarray:
    """Codes (rows, books) of the sums of codewords that beam search finds nearest to each row of x."""
    m, k, d = books.shape
    own = (books**2).sum(2)
    out = np.empty((len(x), m), np.int64)
    for lo in range(0, len(x), rows):
        rest = x[lo : lo + rows, None, :]  # what each state of the beam leaves over
        n = len(rest)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for j in range(m):
            full = ((rest.reshape(-1, d) @ books[j].T) * -2 + own[j]).reshape(n, -1, k)
            full = (full + cost[:, :, None]).reshape(n, -1)
            kept = min(beam if j < m - 1 else 1, full.shape[1])
            best = np.argpartition(full, kept - 1, axis=1)[:, :kept]
            cost, state, word = np.take_along_axis(full, best, 1), best // k, best % k
            rest = np.take_along_axis(rest, state[:, :, None], 1) - books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, state[:, :, None], 1), word[:, :, None]], 2)
        out[lo : lo + rows] = codes[:, 0]
    return out


def fit(x: np.ndarray, books: int = 32, words: int = 64, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions) of unit vectors: residual k-means, then encoding and least squares by turns."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    k = max(1, min(words, 256, len(x) // 4))
    rest, out = x.copy(), np.zeros((books, k, x.shape[1]), np.float32)
    for j in range(books):
        out[j] = _means(rest, k, 8, rng)
        rest -= out[j][(rest @ out[j].T - (out[j] ** 2).sum(1) / 2).argmax(1)]
    for _ in range(rounds):
        at = encode(x, out)
        pairs = np.block([[np.bincount(at[:, i] * k + at[:, j], minlength=k * k).reshape(k, k) for j in range(books)] for i in range(books)])
        sums = np.concatenate([_sums(x, at[:, j], k) for j in range(books)])
        weight = 0.3 * max(1.0, len(x) / (books * k))  # towards the words as they are, so that rare ones stay put
        solved = np.linalg.solve(pairs + weight * np.eye(books * k), sums + weight * out.reshape(books * k, -1))
        out = solved.reshape(out.shape).astype(np.float32)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: Column) -> Column:
    """Neither null, empty, zero nor with components that are null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaled first, so that neither huge nor tiny components overflow."""
    scale = np.abs(x).max(1, keepdims=True, initial=0)
    unit = x / scale
    length = np.sqrt((unit**2).sum(1, keepdims=True))
    return (unit / length).astype(np.float32), np.minimum(scale * length, np.finfo(np.float64).max)[:, 0]


def fitted(classes: DataFrame, sample: int, books: int, words: int) -> np.ndarray:
    """Codebooks of at most `sample` distinct vectors, fitted in one task; the driver gets the codebooks alone."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_matrix(b.column("vec")) for b in batches if b.num_rows]
        if held:
            found = fit(directions(np.concatenate(held))[0], books, words)
            yield pa.RecordBatch.from_arrays([pa.array(found.shape[1:2]), pa.array([found.tobytes()], pa.binary())], ["k", "body"])

    drawn = classes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(sample).select("vec").coalesce(1)
    row = drawn.mapInArrow(lean(train), "k long, body binary").first()
    return np.zeros((books, 1, 1), np.float32) if row is None else np.frombuffer(row.body, np.float32).reshape(books, row.k, -1)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, top: int) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the usable rows, repeats gone, and (vec, ids) of the distinct vectors with their top + 1 smallest ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0 is 0
    rows = stored(rows.distinct(), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("vec") == (sizes.d if sizes else 0))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    classes = rows.withColumn("place", place).where(F.col("place") <= top + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows, classes


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, every: int = 20, books: int = 32, words: int = 64, beam: int = 4, pool: int = 200, sample: int = 16_384, part_rows: int = 16_384) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the `top` nearest of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows, classes = distinct_vectors(df, id_col, vector_col, top)
    classes = stored(classes, "classes")
    found = fitted(classes, sample, books, words)
    shared = spark.sparkContext.broadcast(found)  # books x words x dimensions: its size does not grow with the data
    parts = max(8, -(-classes.count() // part_rows))
    keys = task_keys(spark, parts).tolist()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit, norm = directions(_matrix(b.column("vec")))
                codes = encode(unit, shared.value, beam).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("ids"), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec", "ids", "norm", "code"])

    index = classes.mapInArrow(lean(code), "vec array<double>, ids array<long>, norm double, code binary")
    index = stored(index.withColumn("part", F.pmod(F.xxhash64("vec"), F.lit(parts)).cast("int")), "index")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries, one copy for each part."""
        for b in batches:
            for lo in range(0, b.num_rows, QUERIES_A_BLOCK):
                own = b.slice(lo, QUERIES_A_BLOCK)
                body = [own.column("id").to_numpy().tobytes() + np.ascontiguousarray(_matrix(own.column("vec"))).tobytes()]
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([own.num_rows], pa.int64()), pa.array(body, pa.binary())], ["part", "n", "body"])

    asked = rows.where(F.col("id") % every == 0).select("id", "vec").mapInArrow(lean(blocks), "part int, n long, body binary")
    none = lambda kind: F.lit(None).cast(kind)
    both = index.select("part", "vec", "ids", "norm", "code", none("long").alias("n"), none("binary").alias("body")).union(
        asked.select("part", none("array<double>"), none("array<long>"), none("double"), none("binary"), "n", "body")
    )
    place = F.element_at(F.array(*map(F.lit, keys)), F.col("part") + 1) if parts <= 4096 else F.col("part")
    both = both.withColumn("place", place).repartition(parts, "place").sortWithinPartitions("place", F.col("n").asc_nulls_first())

    def answer(own: tuple, n: int, body: bytes) -> pa.RecordBatch:
        vec, ids, ends, norm, codes = own
        who = np.frombuffer(body, np.int64, n)
        asked_ = np.frombuffer(body, np.float64, offset=8 * n).reshape(n, -1)
        unit = directions(asked_)[0]
        score = np.zeros((len(vec), n), np.float32)
        for j, book in enumerate(shared.value):
            score += (book @ unit.T)[codes[:, j]]
        with np.errstate(over="ignore"):
            score = (score * norm[:, None]).T  # the norms are doubles
        most = min(pool, len(vec))
        near = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < len(vec) else np.tile(np.arange(most), (n, 1))
        out = []
        for q, mine in enumerate(near):
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (vec[mine] * asked_[q]).sum(1)
            runs = ends[mine + 1] - ends[mine]
            named = ids[np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(ends[mine], runs)]
            value = np.repeat(exact, runs)
            good = (named != who[q]) & ~np.isnan(value)
            named, value = named[good], value[good]
            order = np.lexsort((named, -value))
            if len(np.unique(named)) < len(named):  # an id on several vectors: its best product counts
                order = order[np.sort(np.unique(named[order], return_index=True)[1])]
            first = order[:top]
            out.append((np.full(len(first), who[q]), named[first], value[first]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, own = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            place, questions = b.column("place").to_numpy(), b.column("n").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (questions[1:] != questions[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if place[lo] != last:
                    last, waiting, own = place[lo], [], None
                here = b.slice(lo, hi - lo)
                if not questions[lo]:
                    waiting.append(here.select(["vec", "ids", "norm", "code"]))
                    continue
                if own is None and waiting:
                    t = pa.Table.from_batches(waiting)
                    ids = t.column("ids").combine_chunks()
                    ends = np.r_[0, np.cumsum(ids.value_lengths().to_numpy().astype(np.int64))]
                    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    own, waiting = (_matrix(t.column("vec")), ids.flatten().to_numpy(), ends, t.column("norm").to_numpy(), codes), []
                if own is not None:
                    for n, body in zip(here.column("n").to_pylist(), here.column("body").to_pylist(), strict=True):
                        yield answer(own, n, body)

    kept = both.mapInArrow(lean(search), "query_id long, vec_id long, score double")
    kept = kept.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
