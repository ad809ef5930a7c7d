"""Benchmark decontamination by spaced-seed hashing.

A text is its words: runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased; in scripts
written without blanks (Han, kana, Thai) each character is a word. Each seed is a mask over some words of which only the
marked positions are hashed, so a substituted word under an unmarked position does not hurt. Seeds of all test items are
held in one table; every document is hashed at every word under every mask. A hit names an item and a diagonal (document
word minus item word). It is an overlap if any stretch along it has `least` equal words and at least `identity` of the
stretch's words agree; of such stretches the one with most equal words is given, so a passage counts whatever was rewritten
beside it. MASKS hit every such stretch of 10 words at 75 %, whichever words are substituted (tests enumerate 10 of 13, 12
of 16, 13 of 17 and 15 of 20).

Items too short for that: of 8 words up to `least` / `identity` the whole item must be there with `identity` of its words
(SHORT_MASKS hit all of these), of `shortest` to 7 words with all of them, and one of fewer words is found only where it is a
document's whole text.

The item table is broadcast in blocks of at most `block_words` words, each of which makes its own pass over the documents;
so its size is bounded while every item counts. Documents are never shuffled. Diagonals are judged some at a time, in columns.

Nulls: a null or wordless text or item overlaps with nothing; a null item id or document id is carried through. Repeated
rows are each reported. Of several overlaps of one row and item the one with most equal words is given, the first of equals.
Very long texts are searched whole. Columns beside ids and texts are not read by benchmark_overlaps and are handed through by
without_overlaps, whatever their names. Empty tables give no rows, and an empty benchmark lets all documents pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import keyed, lean, mix, run_hashes, slices, spans, utf8

MASKS = ("111011", "1100001011", "111100001", "11111")
SHORT_MASKS = ("11101", "100111", "1101001")
SHORT = 8
DIAGONALS = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
FILTER_BITS = 22


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order and each text's first word, n + 1."""
    data, offs = utf8(pc.utf8_lower(column))
    starts, ends = spans(data, offs, _WORD[data])
    # characters of three bytes from U+3000 to U+9FFF and of Thai are words of their own
    lone = (data >= 0xE3) & (data <= 0xE9)
    lone[:-1] |= (data[:-1] == 0xE0) & (data[1:] >> 1 == 0xB8 >> 1)
    if lone.any():
        at = np.flatnonzero(lone)
        starts = np.union1d(starts, np.r_[at, at + 3])
        starts = starts[np.r_[_WORD[data], False][starts]]
        stop = np.r_[np.flatnonzero(~_WORD[data]), len(data)]
        ends = np.minimum(np.r_[starts[1:], len(data)], np.minimum(stop[np.searchsorted(stop, starts)], offs[np.searchsorted(offs, starts, "right")]))
    return run_hashes(data, starts, ends), np.searchsorted(starts, offs)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked words from each word on, as far as the mask fits into h."""
    s = np.zeros(max(0, len(h) - len(mask) + 1), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            s += h[j : j + len(s)] * _ODD[j % 64]
    return mix(s + np.uint64(len(mask)))


def best_stretches(same: np.ndarray, n: np.ndarray, identity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of equal and different words, n long and end on end: start, end and equal words of the stretch with most
    equal words among those of which at least `identity` agree."""
    share = Fraction(identity).limit_denominator(10**6)
    up, down = share.denominator - share.numerator, share.numerator
    line = np.repeat(np.arange(len(n)), n + 1)  # one prefix sum before each word and one after the last
    head = np.r_[0, np.cumsum(n + 1)[:-1]].astype(np.int64)
    inner = np.ones(len(line), bool)
    inner[head] = False
    gain, one = np.zeros(len(line), np.int64), np.zeros(len(line), np.int64)
    gain[inner], one[inner] = np.where(same, up, -down), same
    run, equal = np.cumsum(gain), np.cumsum(one)
    run -= run[head][line]
    # each line lies wholly below the one before, so the least sum so far is the line's own
    run -= line * (share.denominator * (int(n.max(initial=0)) + 1) * 2)
    first = np.searchsorted(-np.minimum.accumulate(run), -run)  # per end the earliest start from which the sum is not negative
    most = equal - equal[first]
    top = np.maximum.reduceat(most, head) if len(head) else most
    at = np.flatnonzero(most == top[line])
    end = at[np.searchsorted(line[at], np.arange(len(n)))]
    start = first[end]
    # trimmed to equal words at both ends
    hits = np.flatnonzero(one)
    low, high = np.searchsorted(hits, start, "right"), np.searchsorted(hits, end, "right") - 1
    some = top > 0
    low, high = (hits[np.minimum(x, max(0, len(hits) - 1))] if len(hits) else np.zeros(len(n), np.int64) for x in (low, high))
    return np.where(some, low - 1 - head, 0), np.where(some, high - head, 0), top


class SeedTable:
    """All seeds of a block of items: sorted hashes with item and position, and a bit filter before the search."""

    def __init__(self, ids: list, h: np.ndarray, at: np.ndarray, masks: tuple[str, ...], shortest: int, least: int, identity: float):
        self.ids, self.words, self.at = ids, h, at
        self.n = n = np.diff(at)
        share = Fraction(identity).limit_denominator(10**6)
        long = -(-least * share.denominator // share.numerator)
        part = -(-n * share.numerator // share.denominator)  # of a short item so many words have to agree
        self.need = np.where(n >= long, least, np.where(n >= SHORT, part, n))
        self.whole = n < long
        found = []
        for k, length in enumerate(n.tolist()):
            if length >= long:
                fits = masks
            elif length >= SHORT:
                fits = SHORT_MASKS
            else:
                fits = ("1" * length,) if length >= shortest else ()
            found += [(m, k) for m in fits]
        self.masks = sorted({m for m, _ in found})
        parts = [(s := seeds(h[at[k] : at[k + 1]], m), np.full(len(s), k), np.arange(len(s))) for m, k in found]
        key, item, place = (np.concatenate([f[c] for f in parts]) if parts else np.zeros(0, t) for c, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        tiny = np.flatnonzero((n > 0) & (n < shortest))
        self.tiny: dict[bytes, list[int]] = {}
        for k in tiny.tolist():
            self.tiny.setdefault(h[at[k] : at[k + 1]].tobytes(), []).append(k)
        self.shortest = shortest

    def _hits(self, h: np.ndarray, at: np.ndarray, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, shift) of seed hits, some at a time; shift: the text's word under the item's first word. Texts that are done give no more."""
        for m in self.masks:
            s = seeds(h, m)
            i = np.flatnonzero(self.filter[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[i], "left"), np.searchsorted(self.key, s[i], "right")
            i, lo, n = i[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            doc = np.searchsorted(at, i, "right") - 1
            inside = i + len(m) <= at[doc + 1]
            i, lo, n, doc = i[inside], lo[inside], n[inside], doc[inside]
            upto = np.cumsum(n)
            for k in np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(n) else 0, DIAGONALS), "right")).tolist():
                to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + DIAGONALS, "right")))
                c = slice(k, to) if done is None else np.arange(k, min(to, len(n)))[~done[doc[k:to]]]
                which = np.repeat(lo[c], n[c]) + np.arange(n[c].sum()) - np.repeat(np.cumsum(n[c]) - n[c], n[c])
                yield np.repeat(doc[c], n[c]), self.item[which], np.repeat(i[c], n[c]) - self.place[which]

    def _verified(self, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, h: np.ndarray, at: np.ndarray, identity: float) -> Iterator[tuple[int, ...]]:
        """text, item, document word, item word, words and equal words of the diagonals that hold an overlap, some diagonals at a time."""
        a, n = self.at[item], self.n[item]
        lo, hi = np.maximum(shift, at[doc]), np.minimum(shift + n, at[doc + 1])
        size, k = np.cumsum(hi - lo), 0
        while k < len(doc):
            to = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + DIAGONALS, "right")))
            c = slice(k, to)
            m = hi[c] - lo[c]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            same = h[np.repeat(lo[c], m) + step] == self.words[np.repeat(a[c] + lo[c] - shift[c], m) + step]
            start, end, equal = best_stretches(same, m, identity)
            all_ = np.add.reduceat(same, np.cumsum(m) - m, dtype=np.int64)
            whole = self.whole[item[c]]  # a short item counts by all its words
            start, end, equal = np.where(whole, 0, start), np.where(whole, m, end), np.where(whole, all_, equal)
            for j in np.flatnonzero((equal >= self.need[item[c]]) & (~whole | (m == n[c]))).tolist():
                d = int(doc[k + j])
                yield d, int(item[k + j]), int(lo[k + j] - at[d] + start[j]), int(lo[k + j] - shift[k + j] + start[j]), int(end[j] - start[j]), int(equal[j])
            k = to

    def overlapping(self, h: np.ndarray, at: np.ndarray, identity: float) -> np.ndarray:
        """Whether each text overlaps with any item. A text is done at its first overlap, and no hits are kept: a stem that many items share is no more work."""
        done = np.zeros(len(at) - 1, bool)
        for hit in self._hits(h, at, done):
            doc, item, shift = np.unique(np.stack(hit, 1), axis=0).T if len(hit[0]) else hit
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            for k in range(int(place.max(initial=-1) + 1).bit_length()):  # a text's first diagonal, then two, then four
                c = np.flatnonzero((place + 1 >= 1 << k) & (place + 1 < 2 << k) & ~done[doc])
                done[[v[0] for v in self._verified(doc[c], item[c], shift[c], h, at, identity)]] = True
        if self.tiny:
            length = np.diff(at)
            for d in np.flatnonzero((length > 0) & (length < self.shortest) & ~done).tolist():
                done[d] = h[at[d] : at[d + 1]].tobytes() in self.tiny
        return done

    def overlaps(self, h: np.ndarray, at: np.ndarray, least: int, identity: float) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(text, item): document word, item word, words and equal words of the best overlap."""
        seen = [np.zeros(0, np.int64)] * 3
        for hit in self._hits(h, at):
            seen = [np.r_[x, y] for x, y in zip(seen, hit, strict=True)]
            order = np.lexsort(seen[::-1])
            seen = [x[order] for x in seen]
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in seen], axis=0)
            seen = [x[new] for x in seen]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for d, k, *found in self._verified(*seen, h, at, identity):
            if found[3] > best.get((d, k), (0, 0, 0, 0))[3]:
                best[d, k] = tuple(found)
        if self.tiny:
            length = np.diff(at)
            for d in np.flatnonzero((length > 0) & (length < self.shortest)).tolist():
                for k in self.tiny.get(h[at[d] : at[d + 1]].tobytes(), ()):
                    best[d, k] = (0, 0, int(length[d]), int(length[d]))
        return best


def _tables(benchmark: DataFrame, item_id: str, item_text: str, masks: tuple[str, ...], shortest: int, block_words: int, least: int, identity: float) -> Iterator[SeedTable]:
    items = keyed(benchmark, item_id, item_text).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    for k in range(blocks):
        t = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").toArrow().combine_chunks()
        h, at = words_of(pa.chunked_array(t.column("text"), pa.string()).combine_chunks() if t.num_rows else pa.array([], pa.string()))
        yield SeedTable(t.column("id").to_pylist(), h, at, masks, shortest, least, identity)


def benchmark_overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: int = 10, identity: float = 0.75, shortest: int = 5, block_words: int = 500_000) -> DataFrame:
    """One row per row of df and item that overlap: ids, doc_word, item_word (0-based starts), n_words, n_equal."""
    docs, out = keyed(df, id_col, text_col), None
    for table in _tables(benchmark, item_id, item_text, masks, shortest, block_words, least, identity):
        shared = df.sparkSession.sparkContext.broadcast(table)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                h, at = words_of(b.column("text"))
                found = shared.value.overlaps(h, at, least, identity)
                if found:
                    ids = b.column("id")
                    rows = [(ids[d].as_py(), shared.value.ids[k], *v) for (d, k), v in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["d", "i", "doc_word", "item_word", "n_words", "n_equal"])

        part = docs.mapInArrow(lean(search), "d long, i long, doc_word long, item_word long, n_words long, n_equal long")
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"d": id_col, "i": item_id})


def without_overlaps(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: int = 10, identity: float = 0.75, shortest: int = 5, block_words: int = 500_000) -> DataFrame:
    """The rows of df, all columns as they are, that overlap with no item; neither a join nor a shuffle."""
    for table in _tables(benchmark, item_id, item_text, masks, shortest, block_words, least, identity):
        shared = df.sparkSession.sparkContext.broadcast(table)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                h, at = words_of(b.column(text_col))
                bad = shared.value.overlapping(h, at, identity)
                yield b.filter(pa.array(~bad)) if bad.any() else b

        df = df.mapInArrow(lean(keep), df.schema)
    return df
