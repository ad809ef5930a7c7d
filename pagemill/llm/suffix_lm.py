"""Language-model scoring by a probabilistic suffix tree over words.

States are word contexts of length 0 to `depth`, read backwards; the start of a text is the word before its first. A context is
a candidate if its training count reaches `min_count` and its next shorter one is a candidate; a candidate is a state if it
passes the divergence test: its count times the Kullback-Leibler divergence of its next-word distribution from that of its
longest suffix that is a state reaches `divergence` (natural log). Levels grow from candidates, so a context counts even if
the words between made no difference. A text is scored by the longest suffix of the words read so far that is a state.

Smoothing interpolates down the states of the suffix chain. With counts c of a state and the distribution p' of the next
shorter one, p(x) = (c(x) + m * p'(x)) / (c + m), m being `root_pseudo` above the root and `pseudo` elsewhere; the root has
p(x) = (c(x) + 1) / (N + V + 1), the one beyond the V known tokens for all others. So every distribution sums to 1.

Words are compared by 64 bits. The at most `head_words` most frequent ones (all of one count or none of it) have short codes,
whose table with counts is broadcast, a fixed size; all other words travel as 64 bits and are counted like any. Only the root's
share in the divergence test takes the words beyond the head as equally frequent among themselves.

Every position (`depth` - 1 words back, word, next word) is sent to the partition of its middle word, the last word of its
contexts: there lie all next words of that context and all its longer contexts. A word that would fill more than half a
partition is split by the word before it: its pairs with next words are counted beforehand and go to each of its partitions,
longer contexts lie whole in one. (The start of a text has no longer contexts and is split by text.) A partition holds about
`part_tokens` positions, their number grows with the corpus. What a position adds to its text's score goes back to the
slice of the input that the text is in; where the next word is beyond the head, the two terms of its probability and, from
the partition where that word stands in the middle, its count, meet there.

Tokens: lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ and one end a text. A null text is empty: one token, the end. Rows
are scored one by one, repeated rows alike; a null id counts as remainder 0 and trains. Very long texts are read whole.
Columns beside id and text are not read, whatever their names. An empty table gives no rows; if no row trains, the root is
uniform. Logarithms are added per text and partition and sent as 32-bit floats, so scores are exact to some 1e-7 of their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import cleared, keyed, lean, mix, remainder, slices, stored, streamed, task_keys, trimmed, word_hashes

NONE, BEGIN, END, TAIL, FIRST = 0, 1, 2, 3, 4  # codes; head words follow
FAR = np.uint32(1 << 24)
FAR_WORD = np.uint64(1 << 63)
BYTES_A_TOKEN = 6
SLICE, ROW_BYTES, WIDEST = 6 << 20, 1 << 12, 32 << 20
FINE = 1 << 16


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x))


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _planes(x: np.ndarray) -> bytes:
    """Small numbers by planes of bytes: the upper ones are nearly empty."""
    width = 2 if not x.size or x.max() < 1 << 16 else 4
    return bytes([width]) + _pack(np.ascontiguousarray(x.astype(f"<u{width}").reshape(-1, 1).view(np.uint8).T))


def _numbers(x: bytes) -> np.ndarray:
    planes = _unpack(x[1:], np.uint8)
    return np.ascontiguousarray(planes.reshape(x[0], -1).T).view(f"<u{x[0]}").ravel().astype(np.uint32)


def _starts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct key, and at each position the number of its key."""
    order = np.argsort(key)
    starts = _starts(key[order])
    number = np.empty(len(key), np.uint32)
    number[order] = np.repeat(np.arange(len(starts), dtype=np.uint32), np.diff(np.r_[starts, len(key)]))
    return order[starts], number


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b


@dataclass
class Head:
    """Frequent words in order of hash, their codes in order of frequency, and the counts of all codes; sums over all words."""

    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    least: int  # every word of this count or more is in the head
    base_parts: int
    first: np.ndarray  # of a split code its first partition, else -1
    subs: np.ndarray

    def code(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), TAIL, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.codes[at], TAIL).astype(np.uint32)

    @property
    def floor(self) -> float:
        return float(self.tokens + self.types + 1)

    def share(self, codes: np.ndarray) -> np.ndarray:
        """The share of these words in all training tokens; of a word beyond the head that of one of them on the mean."""
        kinds = self.types - np.count_nonzero(self.counts)
        even = max(1e-9, (self.tokens - int(self.counts.sum())) / kinds) if kinds > 0 else 1e-9
        return np.where(codes == TAIL, even, np.maximum(self.counts[codes], 1e-9)) / max(1, self.tokens)

    @property
    def parts(self) -> int:
        return self.base_parts + int(self.subs.sum())


class Slice:
    """Positions of the texts of a slice: code, hash and text of each middle word, in order; its neighbours are looked up."""

    def __init__(self, column: pa.Array, head: Head):
        h, at = word_hashes(column)
        self.n = np.diff(at)
        kinds, inverse = np.unique(h, return_inverse=True)
        total = len(h) + len(self.n)
        self.heads = at[:-1] + np.arange(len(self.n))
        inner = np.ones(total, bool)
        inner[self.heads] = False
        self.code, self.hash = np.full(total, BEGIN, np.uint32), np.zeros(total, np.uint64)
        self.code[inner], self.hash[inner] = head.code(kinds)[inverse], h
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n + 1)

    def next(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and hash of the next word of these positions; the end after a text's last."""
        at = e + 1
        last = at == (self.heads + self.n + 1)[self.doc[e]]
        at = np.where(last, 0, at)
        return np.where(last, np.uint32(END), self.code[at]), np.where(last, np.uint64(0), self.hash[at])

    def back(self, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Code and hash of the word k before the middle one, NONE beyond the start."""
        at = e - k
        ok = at >= self.heads[self.doc[e]]
        at = np.maximum(at, 0)
        return np.where(ok, self.code[at], np.uint32(NONE)), np.where(ok, self.hash[at], np.uint64(0))


def _wide_planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: their differences by planes of bytes."""
    return _pack(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).reshape(-1, 1).view(np.uint8).T))


def _wide_numbers(x: bytes) -> np.ndarray:
    planes = _unpack(x, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """(h, c): training count of each word. Counts of some megabytes of text are packed and sent at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                h, c = _summed(*map(list, zip(*held, strict=True)))
                held.clear()
                part = (h % np.uint64(parts)).astype(np.int64)
                rows = [(p, _wide_planes(h[e]), _pack(c[e].astype(np.uint32))) for p in range(parts) if len(e := np.flatnonzero(part == p))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "hs", "cs"])

        for b in slices(batches, most=SLICE):
            h, at = word_hashes(b.column("text"))
            train = np.repeat(~b.column("held").to_numpy(zero_copy_only=False), np.diff(at))
            held.append(np.unique(h[train], return_counts=True))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield from out()
        yield from out()

    def add(t: pa.Table) -> pa.RecordBatch:
        h, c = _summed([_wide_numbers(x) for x in t.column("hs").to_pylist()], [_unpack(x, np.uint32) for x in t.column("cs").to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return streamed(docs.mapInArrow(lean(run), "part int, hs binary, cs binary"), ["part"], add, "h long, c long", parts)


def head_of(words: DataFrame, texts: int, head_words: int, part_tokens: int, bulk: float) -> Head:
    """The head of the vocabulary and the partitions; what comes to the driver has a fixed bound."""
    step = F.when(F.col("c") < FINE, F.col("c")).otherwise(FINE + F.floor(F.log2(F.col("c") / FINE) * 128)).cast("long")
    levels = sorted(words.groupBy(step.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    from_, n = None, 0
    for level, kinds, _ in levels:
        n += kinds
        if n > head_words:
            break
        from_ = level
    found = words.where(step >= from_).toArrow() if from_ is not None else None
    h, c = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if found is None else (found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy())
    order = np.lexsort((h, -c))
    counts = np.r_[np.zeros(FIRST, np.int64), c[order]]
    counts[END] = texts
    codes = np.empty(len(h), np.uint32)
    codes[order] = np.arange(FIRST, FIRST + len(h))
    by_hash = np.argsort(h)
    tokens = sum(r[2] for r in levels) + texts
    # positions of each word, held-out ones by proportion
    grown = max(1.0, bulk / max(1, tokens))
    size = counts * grown
    size[BEGIN], size[END] = texts * grown, 0
    subs = np.where(size > part_tokens / 2, np.ceil(size / (part_tokens / 2)), 0).astype(np.int64)
    rest = max(0.0, bulk - size[subs > 0].sum())
    base = max(6, -(-int(rest) // part_tokens))
    first = np.where(subs > 0, base + np.cumsum(subs) - subs, -1)
    return Head(h[by_hash], codes[by_hash], counts, tokens, sum(r[1] for r in levels) + (1 if texts else 0), int(c.min()) if len(c) == sum(r[1] for r in levels if r[0] >= (from_ or 0)) and len(c) else 1 << 62, base, first, subs)


def split_pairs(docs: DataFrame, shared, split: list[int], keys: list[int]) -> DataFrame:
    """(part, xs, ns): training counts of the next words of each split word, for each of its partitions.

    Pairs are counted by slice, packed, and added up in as many shares of the next words as the word has partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for b in slices(batches, most=SLICE):
            s = Slice(b.column("text"), head)
            on = np.flatnonzero((head.subs[s.code] > 0) & ~b.column("held").to_numpy(zero_copy_only=False)[s.doc])
            code, h = s.next(on)
            x, w = np.where(code == TAIL, h | FAR_WORD, code.astype(np.uint64)), s.code[on]
            order = np.lexsort((x, w))
            w, x = w[order], x[order]
            at = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (x[1:] != x[:-1])]) if len(w) else np.zeros(0, np.int64)
            w, x, n = w[at], x[at], np.diff(np.r_[at, len(w)])
            place = head.first[w] + (mix(x) % np.maximum(head.subs[w], 1).astype(np.uint64)).astype(np.int64)
            rows = []
            for p in np.unique(place).tolist():
                e = place == p
                rows.append((int(w[e][0]), p, _wide_planes(x[e]), _pack(n[e].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["w", "place", "xs", "ns"])

    def add(t: pa.Table) -> pa.RecordBatch:
        x, n = _summed([_wide_numbers(v) for v in t.column("xs").to_pylist()], [_unpack(v, np.uint32) for v in t.column("ns").to_pylist()])
        return pa.RecordBatch.from_arrays([t.column("w")[:1].combine_chunks(), pa.array([_wide_planes(x)], pa.binary()), pa.array([_pack(n)], pa.binary())], ["w", "xs", "ns"])

    head = shared.value
    where = docs.sparkSession.createDataFrame([(k, keys[head.first[k] : head.first[k] + head.subs[k]]) for k in split], "w_ int, parts array<int>")
    pairs = streamed(docs.mapInArrow(lean(count), "w int, place int, xs binary, ns binary"), ["place"], add, "w int, xs binary, ns binary", int(head.subs.sum()))
    return pairs.join(F.broadcast(where), F.col("w") == F.col("w_")).select(F.explode("parts").alias("part"), "xs", "ns")


def suffix_tree_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, divergence: float = 2.0, min_count: int = 2, root_pseudo: float = 50.0, pseudo: float = 3.0, depth: int = 5, part_tokens: int = 1_000_000, head_words: int = 2_000_000, step: int = 250_000) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col).select("id", (remainder("id", modulus) == held).alias("held"), "text")
    size, rows, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(~F.col("held"))).first()
    scratch: list[str] = []
    words = stored(word_counts(docs, max(12, int(size) >> 25)), "words", scratch)
    shared = spark.sparkContext.broadcast(head := head_of(words, texts, head_words, part_tokens, size / BYTES_A_TOKEN + rows))
    cleared(spark, scratch)
    keys = task_keys(spark, head.parts).tolist()
    parts, wide = head.parts, min(WIDEST, max(SLICE, ROW_BYTES * head.parts))
    blob = "part int, slice long, mid binary, docs binary, words binary, tails binary, places binary, xs binary, ns binary, info binary"

    def deal(numbered: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for b in slices(numbered, most=wide):
            s, name = Slice(b.column("text"), head), b.column("row")[0].as_py()
            held_ = b.column("held").to_numpy(zero_copy_only=False)
            # the words of the text as predicted words: base terms of the head's
            x = s.next(np.arange(len(s.code)))[0]
            at = x != TAIL
            seen = head.counts[x[at]]
            base = np.bincount(s.doc[at], np.log10((seen + 1) / head.floor), len(s.n))
            known = np.bincount(s.doc[at], seen > 0, len(s.n)).astype(np.int64)
            ids = b.column("id")
            info = pa.record_batch([ids, pa.array(held_), pa.array(s.n + 1), pa.array(known), pa.array(base)], ["id", "held", "n_tokens", "n_known", "base"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, info.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(info)
            part = (np.where(s.code == TAIL, s.hash, mix(s.code.astype(np.uint64))) % np.uint64(head.base_parts)).astype(np.int64)
            split = np.flatnonzero(head.subs[s.code] > 0)
            if len(split):
                code, h = s.back(split, 1)
                by = np.where(code == TAIL, h, mix(code.astype(np.uint64) + np.uint64(1)))
                by = np.where(s.code[split] == BEGIN, mix(np.uint64(name) + s.doc[split].astype(np.uint64)), by)
                part[split] = head.first[s.code[split]] + (by % head.subs[s.code[split]].astype(np.uint64)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            cuts, out = np.searchsorted(part[order], np.arange(parts + 1)), []
            del part, x, at, seen
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                e = order[cuts[p] : cuts[p + 1]]
                columns, on = [(s.code[e], s.hash[e]), s.next(e)], None
                for k in range(depth):  # a word too rare for a context that counts ends it
                    code, h = columns[0] if not k else s.back(e, k)
                    rare = head.counts[code] < min_count
                    rare = rare & ((code >= FIRST) | (head.least <= min_count) & (code == TAIL))
                    on = ~rare if on is None else on & ~rare
                    if k:
                        columns.append((np.where(on, code, np.uint32(NONE)), h))
                tails = [h[c == TAIL] for c, h in columns]
                places = np.r_[e[columns[1][0] == TAIL] + 1, e[columns[0][0] == TAIL]]  # of the predicted word
                d = s.doc[e]
                own, local, many = np.unique(columns[0][0], return_inverse=True, return_counts=True)
                often = np.argsort(-many, kind="stable")
                own, place = own[often], np.argsort(often)
                out.append((keys[p], name, len(packed := _planes(own)).to_bytes(4, "little") + packed + _planes(place[local]), _planes(np.diff(np.r_[0, d]) * 2 + held_[d]), _planes(np.concatenate([c for c, _ in columns[1:]])), _pack(np.concatenate(tails)), _pack(places.astype(np.uint32)), None, None, None))
            out.append((keys[name % parts], name, *[None] * 7, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 8), strict=True)], [x.split()[0] for x in blob.split(", ")])
            del s, out, order, cuts, columns, tails, places, d, own, local
            trimmed()

    back_blob = "slice long, docs binary, sums binary, asked binary, terms binary, told binary, counts binary, info binary"

    def judged(mid: np.ndarray, x: np.ndarray, backs: list[np.ndarray], train: np.ndarray, flat: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
        """Of positions of whole middle words: the terms a and b of each, p = a + b * p0, and the middle word's count."""
        head = shared.value
        rs = head.share(np.where(x >= FAR, np.uint32(TAIL), x))
        count = lambda number, n: np.bincount(number[train], minlength=n)
        # one word
        each, own = _groups(mid)
        c = count(own, len(each))
        first, pair = _groups(_pair(own, x))
        cx = count(pair, len(first))
        if table:  # a split word, which is alone in its partition
            xs, ns = table
            asked = x[first].astype(np.uint64)
            if len(flat):
                asked = np.where(x[first] >= FAR, flat[np.where(x[first] >= FAR, x[first] - FAR, 0)] | FAR_WORD, asked)
            at = np.minimum(np.searchsorted(xs, asked), len(xs) - 1)
            cx, c = np.where(xs[at] == asked, ns[at], 0), np.array([ns.sum()])
            gain = np.array([(ns * (np.log(ns / c[0]) - np.log(head.share(np.where(xs >= FAR_WORD, TAIL, xs).astype(np.int64))))).sum()])
        else:
            some = first[cx > 0]
            gain = np.bincount(own[some], cx[cx > 0] * (np.log(cx[cx > 0] / c[own[some]]) - np.log(rs[some])), len(each))
        ci, cxi, deep = c[own], cx[pair].astype(np.float64), ((c >= min_count) & (gain >= divergence))[own]
        a, b = np.where(deep, cxi / (ci + root_pseudo), 0.0), np.where(deep, root_pseudo / (ci + root_pseudo), 1.0)
        seen = np.where(deep & (cxi > 0), cxi / np.maximum(ci, 1), rs)
        e = np.flatnonzero(ci >= min_count)
        at_ = own[e]
        # longer contexts, level by level, among the positions whose context is frequent enough
        for back in backs:
            on = back[e] != NONE
            e, at_ = e[on], at_[on]
            if not len(e):
                break
            each, own = _groups(_pair(at_, back[e]))
            c = np.bincount(own[train[e]], minlength=len(each))
            first, pair = _groups(_pair(own, x[e]))
            cx = np.bincount(pair[train[e]], minlength=len(first))
            some = cx > 0
            gain = np.bincount(own[first[some]], cx[some] * (np.log(cx[some] / c[own[first[some]]]) - np.log(seen[e[first[some]]])), len(each))
            on = np.flatnonzero(((c >= min_count) & (gain >= divergence))[own])
            i, n, k = e[on], c[own[on]], cx[pair[on]]
            m = np.where(deep[i], pseudo, root_pseudo)
            a[i], b[i] = (k + m * a[i]) / (n + m), m * b[i] / (n + m)
            seen[i] = np.where(k > 0, k / n, seen[i])
            deep[i] = True
            on = np.flatnonzero(c[own] >= min_count)
            e, at_ = e[on], own[on]
        return a, b, ci

    def score(t: pa.Table) -> pa.RecordBatch | None:
        head = shared.value
        kept = lambda names, one: [r for r in t.select(names).to_pylist() if r[one] is not None]
        rows = [(r["slice"], *[None] * 6, r["info"]) for r in kept(["slice", "info"], "info")]
        tables = kept(["xs", "ns"], "xs")
        pieces = kept(["slice", "docs", "places"], "docs")
        if pieces:
            moved = [_numbers(r["docs"]) for r in pieces]
            cuts = np.r_[0, np.cumsum([len(m) for m in moved])]
            doc, train = np.concatenate([np.cumsum(m >> 1, dtype=np.uint32) for m in moved]), np.concatenate([(m & 1) == 0 for m in moved])
            columns, tails = np.empty((depth + 1, cuts[-1]), np.uint32), [[] for _ in range(depth + 1)]
            codes = (x for b in t.select(["mid", "words", "tails"]).to_batches(max_chunksize=64) for x in b.to_pylist() if x["mid"] is not None)
            for r, lo, hi in zip(codes, cuts[:-1], cuts[1:], strict=True):
                end = 4 + int.from_bytes(r["mid"][:4], "little")
                columns[0, lo:hi] = _numbers(r["mid"][4:end])[_numbers(r["mid"][end:])]
                columns[1:, lo:hi] = _numbers(r["words"]).reshape(depth, -1)
                own, k = _unpack(r["tails"], np.uint64), 0
                for j in range(depth + 1):
                    n = int(np.count_nonzero(columns[j, lo:hi] == TAIL))
                    tails[j].append(own[k : k + n])
                    k += n
            flat = np.unique(np.concatenate([x for c in tails for x in c]))
            told, asked = (np.flatnonzero(columns[j] == TAIL) for j in (0, 1))
            for j, c in enumerate(columns):  # words beyond the head by their place among those of this partition
                c[c == TAIL] = FAR + np.searchsorted(flat, np.concatenate(tails[j])).astype(np.uint32)
            table, word = None, int(columns[0, 0])
            if tables and word < FAR and head.subs[word] > 0:
                xs, ns = (np.concatenate([read(r[k]) for r in tables]) for k, read in (("xs", _wide_numbers), ("ns", lambda v: _unpack(v, np.int64))))
                order = np.argsort(xs)
                table = xs[order], ns[order]
            # whole middle words, about `step` positions at a time
            order = np.argsort(columns[0], kind="stable").astype(np.uint32)
            starts = _starts(columns[0][order])
            ends = np.unique(np.r_[starts[np.unique(np.searchsorted(starts, np.arange(0, len(order), step)).clip(max=len(starts) - 1))], len(order)])
            value, terms, counts = np.empty(len(order), np.float32), np.empty((2, len(asked))), np.empty(len(told), np.int64)
            for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if hi == lo:
                    continue
                e = order[lo:hi]
                e.sort()
                x = columns[1, e]
                a, b, c = judged(columns[0, e], x, [columns[j, e] for j in range(2, depth + 1)], train[e], flat, table)
                near = x < FAR
                value[e] = np.where(near, np.log10(a + b * (head.counts[np.where(near, x, 0)] + 1) / head.floor), 0)
                for kept_, put, those in ((asked, terms, np.stack([a, b])), (told, counts, c)):
                    at = np.searchsorted(e, kept_)
                    ok = np.flatnonzero(e[np.minimum(at, len(e) - 1)] == kept_)
                    put[..., ok] = those[..., at[ok]]
                del a, b, c, x, e, near, those
                trimmed()
            for k, r in enumerate(pieces):
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                d = doc[lo:hi]
                heads = _starts(d)
                sums = np.add.reduceat(value[lo:hi], heads, dtype=np.float64).astype(np.float32)
                q, w = slice(*np.searchsorted(asked, [lo, hi])), slice(*np.searchsorted(told, [lo, hi]))
                places = _unpack(r["places"], np.uint32)
                n = q.stop - q.start
                rows.append((r["slice"], _planes(np.diff(d[heads], prepend=np.uint32(0))), sums.tobytes(), _pack(places[:n]), _pack(terms[:, q]), _pack(places[n:]), _pack(counts[w]), None))
            del columns, order, value, terms, counts, doc, train, moved, pieces
            trimmed()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 7), strict=True)], [x.split()[0] for x in back_blob.split(", ")]) if rows else None

    def total(t: pa.Table) -> pa.RecordBatch | None:
        head = shared.value
        rows = t.to_pylist()
        info = pa.ipc.open_stream(next(r["info"] for r in rows if r["info"] is not None)).read_all().combine_chunks()
        n = info.column("n_tokens").to_numpy()
        base, known, score_ = info.column("base").to_numpy().copy(), info.column("n_known").to_numpy().copy(), np.zeros(len(n))
        count = np.zeros(int(n.sum()) + 1, np.int64)
        pieces = [r for r in rows if r["docs"] is not None]
        for r in pieces:
            score_ += np.bincount(np.cumsum(_numbers(r["docs"])), np.frombuffer(r["sums"], np.float32), len(n))
            count[_unpack(r["told"], np.uint32)] = _unpack(r["counts"], np.int64)
        ends = np.cumsum(n)
        for r in pieces:
            at = _unpack(r["asked"], np.uint32).astype(np.int64)
            if len(at):
                a, b = _unpack(r["terms"], np.float64).reshape(2, -1)
                doc, p0 = np.searchsorted(ends, at, "right"), (count[at] + 1) / head.floor
                score_ += np.bincount(doc, np.log10(a + b * p0), len(n))
                base += np.bincount(doc, np.log10(p0), len(n))
                known += np.bincount(doc, count[at] > 0, len(n)).astype(np.int64)
        return pa.RecordBatch.from_arrays([info.column("id").combine_chunks(), info.column("held").combine_chunks(), pa.array(n), pa.array(known), pa.array(base), pa.array(score_)], ["id", "held", "n_tokens", "n_known", "base", "score"])

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    blobs = numbered.mapInArrow(lean(deal), blob)
    if split := np.flatnonzero(head.subs).tolist():
        pairs = split_pairs(docs, shared, split, keys)
        none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in blob.split(", ")]
        blobs = blobs.unionByName(pairs.select("part", *[c for c, x in zip(none, blob.split(", "), strict=True) if x.split()[0] not in ("part", "xs", "ns")], "xs", "ns"))
    parted = streamed(blobs, ["part"], score, back_blob, parts)
    out = streamed(parted, ["slice"], total, "id long, held boolean, n_tokens long, n_known long, base double, score double", min(parts, 4096))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(head.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
