"""N-gram Jaccard join by signature trees.

Linked are two texts whose sets of distinct five-word shingles have 100 * |A n B| >= threshold * |A u B|. The answer is
exact: every text gets the smallest id that it reaches by links. Nothing is sampled and no bucket is capped.

1. Texts of equal shingle sets become one class (they link at once).
2. Frequency filter: a set A with a partner shares at least threshold % of its shingles with it, so all classes with more
   single-owner shingles than that are done. Hash-partitioned blobs count owners; a shingle common to a slice of the
   input is counted there and sent once, so a passage in a third of all texts is no hot key.
3. Signature trees, two rounds. Round one buckets the survivors by two min-hashes and takes links inside each bucket;
   round two makes it exact: under any one order of all shingles, linked sets share one of their first
   |A| - ceil(threshold % of |A|) + 1, so buckets of these prefixes see every linked pair. The order is by frequency, the
   rare ones first, so a passage that many texts share is in a prefix only if a text holds little else; frequencies come
   from a table of CELLS counters (equal counts are ordered by hash), whose size is fixed.
   Only prefix shingles that two components share are looked at. A tree over the sets sorted by size holds the OR of token
   bitmaps, the size range, the largest surplus of tokens over bits and the most shingles left from the shared one on; a dual
   traversal drops node pairs whose maximum possible overlap is too small, whose size ranges exclude each other or which
   lie in one component already. Bitmaps have four bits a shingle, up to WIDEST; sets of neighbouring widths are compared
   at the narrower one. Pairs that no bound excludes are verified on the full sets, each once.
   Buckets are counted first, on narrow rows, and cut before any set is sent: in round one into cells of a quarter `block`,
   in round two, where every pair counts, into pairs of blocks of `block` members.
4. Components by alternating stars.

Nulls: a null or wordless text has an empty set and links with nothing. A row with a null id keeps its row; it belongs to
its class and links like any other, and the component's id comes from the non-null ids (null if there is none).
Repeated rows stay repeated, and an id on two texts stands for two documents. Columns beside id and text are not read.
Very long texts are read whole; one text's set is held in memory at a time, with others up to about a megabyte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import cleared, components, keyed, lean, mix, sized, slices, stored, streamed, task_keys, word_hashes

NARROWEST, WIDEST = 64, 1 << 15
CELLS = 1 << 18
LEAF, FAN = 16, 8
BUCKET_BYTES = 1 << 26
NOBODY = np.int64(-(2**63))
PART_TOKENS = 4_000_000
SLICE_ROW, WIDEST_SLICE = 1 << 10, 16 << 20


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    h, at = word_hashes(column)
    odd = np.random.default_rng(7).integers(1, 2**63, words + 1, dtype=np.uint64) | np.uint64(1)
    s = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        s += h[j : j + len(s)] * odd[j]
    s, out = mix(s), []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= words:
            x = np.sort(s[lo : hi - words + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif hi > lo:
            short = np.array([hi - lo], np.uint64) * odd[words]
            out.append(mix(short + (h[lo:hi] * odd[: hi - lo]).sum(dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit sums that name a set."""
    return s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: four each, rounded up to a power of two within the limits."""
    return min(WIDEST, max(NARROWEST, 1 << (4 * n - 1).bit_length()))


def signature(s: np.ndarray, width: int) -> np.ndarray:
    """Token bitmap of a set, as 64-bit words; half the width is the OR of both halves."""
    bits = np.zeros(width, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def needed(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Least overlap of linked sets of these sizes: (100 + t) * overlap >= t * (a + b)."""
    return -((-threshold * (a + b)) // (100 + threshold))


class SignatureTree:
    """Sets in order of size, in leaves of 16 under nodes of 8: OR of bitmaps, size range, surplus, component or -1, room.

    room: what a set's overlap with another can be at most, by what is known beside its size.
    """

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, comps: np.ndarray, room: np.ndarray | None = None):
        surplus = sizes - np.bitwise_count(sigs).sum(1, dtype=np.int64)
        self.levels, step = [(sigs, sizes, sizes, surplus, comps, sizes if room is None else room)], LEAF
        while len(self.levels[-1][1]) > 1:
            sig, low, high, more, comp, room = self.levels[-1]
            at = np.arange(0, len(low), step)
            a, b = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            mixed = (a != b) | (a < 0)
            self.levels.append((np.bitwise_or.reduceat(sig, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at), np.where(mixed, -1, a), np.maximum.reduceat(room, at)))
            step = FAN

    def pairs(self, threshold: int, most: int = 200_000, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of set numbers whose bound reaches the need, in chunks; with `other`, only pairs of different sides."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > most:
                stack += [(level, i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)]
                continue
            sig, low, high, more, comp, room = self.levels[level]
            most_ = np.minimum(room[i], room[j])
            if level == 0:
                both = np.bitwise_count(sig[i] & sig[j]).sum(1, dtype=np.int64)
                ones_i, ones_j = low[i] - more[i], low[j] - more[j]
                bound = np.minimum(np.minimum(low[i] - (ones_i - both), low[j] - (ones_j - both)), most_)
                keep = (i != j) & (bound >= needed(low[i], low[j], threshold)) & (comp[i] != comp[j])
                if other is not None:
                    keep &= other[i] != other[j]
            else:
                bound = np.bitwise_count(sig[i] & sig[j]).sum(1, dtype=np.int64) + np.minimum(more[i], more[j])
                bound = np.minimum(np.minimum(bound, most_), np.minimum(high[i], high[j]))
                keep = (bound >= needed(low[i], low[j], threshold)) & (100 * high[i] >= threshold * low[j]) & (100 * high[j] >= threshold * low[i]) & ((comp[i] != comp[j]) | (comp[i] < 0))
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            step, n = (LEAF if level == 1 else FAN), len(self.levels[level - 1][1])
            a, b = (x.ravel() for x in np.broadcast_arrays(i[:, None, None] * step + np.arange(step)[None, :, None], j[:, None, None] * step + np.arange(step)[None, None, :]))
            ok = (a <= b) & (b < n)
            stack.append((level - 1, a[ok], b[ok]))


def candidates(sigs: list[np.ndarray], sizes: np.ndarray, comps: np.ndarray, threshold: int, room: np.ndarray | None = None, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that no bound excludes, of sets in order of size with bitmaps of their own widths.

    Linked sizes differ by less than a factor of two, so only equal and neighbouring widths can be linked. A tree is made of
    each width, and of each two neighbouring ones, the wider folded, of which pairs across are taken.
    """
    wide = np.array([len(x) for x in sigs])
    pick = lambda x, at: None if x is None else x[at]
    for w in np.unique(wide):
        one, two = np.flatnonzero(wide == w), np.flatnonzero(wide == 2 * w)
        own = np.stack([sigs[k] for k in one])
        for i, j in SignatureTree(own, sizes[one], comps[one], pick(room, one)).pairs(threshold, other=pick(other, one)):
            yield one[i], one[j]
        if len(two):
            folded = np.stack([sigs[k] for k in two])
            both, side = np.r_[one, two], np.r_[np.zeros(len(one), np.int8), np.ones(len(two), np.int8)]
            tree = SignatureTree(np.r_[own, folded[:, :w] | folded[:, w:]], sizes[both], comps[both], pick(room, both))
            for i, j in tree.pairs(threshold, other=side):
                ok = np.ones(len(i), bool) if other is None else other[both[i]] != other[both[j]]
                yield both[i[ok]], both[j[ok]]


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def tree_links(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that span the components of these sets: tree traversal, exact verification, no link inside a component twice."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[k] for k in order], sizes[order]
    up, links, n = list(range(len(sets))), [], len(sets)
    flat, at = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]

    def link(a: int, b: int) -> None:
        if (x := _root(up, a)) != (y := _root(up, b)):
            up[max(x, y)] = min(x, y)
            links.append((order[a], order[b]))

    for k in sorted({0, n // 2, n - 1}):  # stars around three members first: copies then lie in one component for the tree
        pos = np.searchsorted(sets[k], flat)
        hit = sets[k][np.minimum(pos, len(sets[k]) - 1)] == flat
        both = np.add.reduceat(hit, at, dtype=np.int64)
        for x in np.flatnonzero(both >= needed(sizes, sizes[k], threshold)):
            link(int(x), k)
    comps = np.array([_root(up, x) for x in range(n)])
    if (comps != comps[0]).any():
        for i, j in candidates([signature(x, width_of(len(x))) for x in sets], sizes, comps, threshold):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if _root(up, a) != _root(up, b) and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= needed(sizes[a], sizes[b], threshold):
                    link(a, b)
    return links


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def prefix(s: np.ndarray, threshold: int, frequency: np.ndarray) -> np.ndarray:
    """The first shingles of a set by frequency, then hash: any linked set shares one of its own first ones with them."""
    n = len(s) + (-threshold * len(s)) // 100 + 1
    return s[np.lexsort((s, frequency[(s >> np.uint64(44)).astype(np.int64) % len(frequency)]))[:n]]


def shingle_frequencies(sets: DataFrame) -> np.ndarray:
    """CELLS counters over the shingles of all sets, added up in packed arrays; a few megabytes come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for s in _sets_of(b.column("toks")):
                n += np.bincount((s >> np.uint64(44)).astype(np.int64) % CELLS, minlength=CELLS)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(n.tobytes())], pa.binary())], ["n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column("n").to_pylist():
                n += np.frombuffer(zstandard.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(n.tobytes())], pa.binary())], ["n"])

    table = sets.select("toks").mapInArrow(lean(count), "n binary").repartition(8).mapInArrow(lean(add), "n binary").collect()
    return sum((np.frombuffer(zstandard.decompress(r[0]), np.int64) for r in table), np.zeros(CELLS, np.int64))


def ngram_jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 75, block: int = 512) -> DataFrame:
    """One row per input row: id, n_shingles, component_id. See the module's docstring for nulls, ties and repeats."""
    found = ngram_jaccard_classes(df, id_col, text_col, words, threshold, block)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def ngram_jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 75, block: int = 512) -> DataFrame:
    """As above under the names id, n_shingles, component_id, with text_key, xxhash64 of the text, and root, which names the component."""
    docs = keyed(df, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    scratch: list[str] = []
    spark = df.sparkSession

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), words)
            sums = np.array([digests(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["id", "text_key", "n", "d1", "d2"])

    rows = stored(docs.mapInArrow(lean(digest), "id long, text_key long, n long, d1 long, d2 long"), "digests")
    classes = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(12, -(-total // PART_TOKENS))
    keys = task_keys(spark, parts).tolist()
    wide = min(WIDEST_SLICE, max(2 << 20, SLICE_ROW * parts))  # of a slice's row for a partition some hundred bytes at least

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=wide):
            sets = shingle_sets(b.column("text"), words)
            ids = np.array([digests(s)[0] for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            # a shingle that this slice holds twice is shared, whoever else has it: it is counted here and sent once, for nobody
            order = np.argsort(flat)
            line = flat[order]
            same = line[1:] == line[:-1]
            twice = np.r_[False, same] | np.r_[same, False] if len(line) else np.zeros(0, bool)
            here = np.bincount(doc[order[twice]], minlength=len(sets))
            first = np.flatnonzero(np.r_[True, ~same] if len(line) else [])
            flat, doc = line[first], np.where(twice[first], len(sets), doc[order[first]])
            part = ((flat >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((doc, part))
            part, doc, low = part[order], doc[order], flat[order].astype(np.uint32)
            cuts, out, owners = np.searchsorted(part, np.arange(parts + 1)), [], np.r_[ids, NOBODY]
            for p in range(parts):
                lo, hi = cuts[p], cuts[p + 1]
                mine = np.flatnonzero((ids % parts == p) & (here > 0))
                if hi > lo or len(mine):
                    d = doc[lo:hi]
                    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if hi > lo else d
                    out.append((keys[p], owners[d[at]].tobytes(), np.diff(np.r_[at, hi - lo]).astype(np.uint32).tobytes(), low[lo:hi].tobytes(), ids[mine].tobytes(), here[mine].astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], ["part", "ids", "runs", "toks", "own", "here"])

    def shared(t: pa.Table) -> pa.RecordBatch | None:
        ids, runs, toks, own, here = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("ids", np.int64), ("runs", np.uint32), ("toks", np.uint32), ("own", np.int64), ("here", np.int32)))
        if len(toks):
            order = np.argsort(toks)
            x = toks[order]
            same = x[1:] == x[:-1]
            twice = np.zeros(len(x), np.int64)
            twice[order] = np.r_[False, same] | np.r_[same, False]
            n = np.add.reduceat(twice, np.r_[0, np.cumsum(runs.astype(np.int64))[:-1]])
            keep = (n > 0) & (ids != NOBODY)
            own, here = np.r_[own, ids[keep]], np.r_[here, n[keep].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(here.astype(np.int32))], ["rep", "s"])

    blobs = docs.mapInArrow(lean(owned), "part int, ids binary, runs binary, toks binary, own binary, here binary")
    counts = streamed(blobs, ["part"], shared, "rep long, s int", parts).groupBy("rep").agg(F.sum("s").alias("s"))
    alive = counts.join(classes, counts.rep == classes.d1).where(f"100 * s >= {threshold} * n * copies").select("least_id", "rep")
    alive = stored(alive, "alive", scratch)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # a task gives the set of a class once, however often its row is repeated
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), words)
            names = np.array([digests(s)[0] for s in sets], np.uint64).view(np.int64)
            asked = b.column("rep")
            mine = (names == asked.fill_null(0).to_numpy()) | asked.is_null().to_numpy(zero_copy_only=False)  # an id may also stand on another text
            mine &= np.array([len(s) > 0 for s in sets], bool)
            for k in np.flatnonzero(mine):
                mine[k] = int(names[k]) not in given
                given.add(int(names[k]))
            sets = [s for s, ok in zip(sets, mine, strict=True) if ok]
            h1 = np.array([s[0] for s in sets], np.uint64).view(np.int64)
            h2 = np.array([mix(s * np.uint64(0xA24BAED4963EE407)).min() for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array(h1), pa.array(h2), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "h1", "h2", "n", "toks"])

    kind = "rep long, h1 long, h2 long, n long, toks binary"
    live = docs.join(sized(alive), docs.id == F.col("least_id")).select("rep", "text").mapInArrow(lean(emit), kind)
    twice = rows.join(sized(alive), (rows.id == F.col("least_id")) & (rows.d1 == F.col("rep"))).groupBy(F.col("rep").alias("rep_")).agg(F.count("*").alias("c")).where("c > 1")
    twice = stored(twice.select("rep_"), "twice", scratch)
    if twice.limit(1).count():  # repeated rows in several tasks: found on narrow rows, so that only their sets are shuffled
        again = sized(twice)
        live = live.join(again, F.col("rep") == F.col("rep_"), "left_anti").union(live.join(again, F.col("rep") == F.col("rep_"), "left_semi").dropDuplicates(["rep"]))
    unnamed = alive.where("least_id IS NULL").select(F.col("rep").alias("rep_"))
    if unnamed.limit(1).count():  # classes of rows without an id: one row of each
        found = docs.where("id IS NULL").select(F.lit(None).cast("long").alias("rep"), "text").mapInArrow(lean(emit), kind).join(sized(stored(unnamed, "unnamed", scratch)), F.col("rep") == F.col("rep_"), "left_semi")
        live = live.union(found.dropDuplicates(["rep"]))
    live = stored(live, "sets", scratch)

    # round one. Buckets are counted and cut, by members and by bytes, on rows without sets; round two joins the cuts
    narrow = live.select("rep", F.explode(F.array("h1", "h2")).alias("key"), "n")
    many = narrow.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("all")).where("c > 1")
    cuts = F.ceil(F.greatest(F.col("c") / (block / 4), F.col("all") * 8 / BUCKET_BYTES))
    many = stored(many.select(F.col("key").alias("key_"), cuts.cast("int").alias("cells")), "buckets", scratch)
    near = narrow.join(sized(many), F.col("key") == F.col("key_")).select(F.col("rep").alias("rep_"), "key", F.pmod(F.xxhash64("rep", "key"), "cells").cast("int").alias("cell"))
    near = live.join(sized(stored(near, "dealt", scratch)), F.col("rep") == F.col("rep_")).select("key", "cell", "rep", "toks")

    def bucket(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        ids = t.column("rep").to_numpy()
        links = tree_links(_sets_of(t.column("toks")), threshold)
        pair = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[pair[:, 0]]), pa.array(ids[pair[:, 1]])], ["u", "v"])

    edges = stored(streamed(near, ["key", "cell"], bucket, "u long, v long"), "links", scratch)
    roots = stored(components(edges), "roots", scratch)
    known = live.join(sized(roots), live.rep == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("comp"), "toks")
    known = stored(known, "known", scratch)

    # round two
    frequency = spark.sparkContext.broadcast(shingle_frequencies(known))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets_of(b.column("toks"))
            heads = [prefix(s, threshold, frequency.value) for s in sets]
            n = [len(x) for x in heads]
            ids, comps, room = (np.repeat(x, n) for x in (b.column("rep").to_numpy(), b.column("comp").to_numpy(), np.array([len(s) for s in sets], np.int64)))
            room = room - (np.arange(len(room)) - np.repeat(np.cumsum(n) - n, n))
            flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            for k in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (flat, ids, comps, room)], ["tok", "rep", "comp", "room"])

    posts = known.mapInArrow(lean(prefixes), "tok long, rep long, comp long, room long")
    open_ = posts.groupBy("tok").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).where("a < b")
    open_ = stored(open_.select(F.col("tok").alias("tok_"), "c"), "open", scratch)
    left = stored(posts.join(sized(open_), F.col("tok") == F.col("tok_")).select("tok", "rep", "room", "c"), "postings", scratch)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets_of(b.column("toks"))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("comp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, width_of(len(s))).tobytes() for s in sets], pa.binary())], ["rep", "comp", "n", "sig"])

    asked = sized(stored(left.select(F.col("rep").alias("rep_")).distinct(), "asked", scratch))
    sigs = known.join(asked, F.col("rep") == F.col("rep_"), "left_semi").mapInArrow(lean(signed), "rep long, comp long, n long, sig binary")
    sigs = stored(sigs.withColumnRenamed("rep", "rep_"), "bitmaps", scratch)
    cells = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "tok"), F.col("cells")).cast("int")
    dealt = left.withColumn("cells", cells).withColumn("own", own).select("tok", "rep", "room", "own", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("with_"))
    dealt = dealt.select("tok", "rep", "room", "own", F.least("own", "with_").alias("x"), F.greatest("own", "with_").alias("y")).join(sigs, F.col("rep") == F.col("rep_")).drop("rep_")

    def traverse(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        order = np.argsort(t.column("n").to_numpy(), kind="stable")
        ids, comps, sizes, room, own = (t.column(c).to_numpy()[order] for c in ("rep", "comp", "n", "room", "own"))
        sigs_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("sig")]
        _, comps_small = np.unique(comps, return_inverse=True)
        apart = own if t.column("x")[0].as_py() != t.column("y")[0].as_py() else None
        found = [(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])) for i, j in candidates([sigs_[k] for k in order], sizes, comps_small, threshold, room, apart)]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["u", "v"])

    pairs = stored(streamed(dealt, ["tok", "x", "y"], traverse, "u long, v long", once=True).distinct(), "pairs", scratch)
    two = pairs.join(known.select(F.col("rep").alias("u_"), F.col("toks").alias("a"), F.col("comp").alias("cu")), F.col("u") == F.col("u_")).join(known.select(F.col("rep").alias("v_"), F.col("toks").alias("b"), F.col("comp").alias("cv")), F.col("v") == F.col("v_"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _sets_of(b.column("a")), _sets_of(b.column("b"))
            ok = pa.array([len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), threshold) for x, y in zip(a, c, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("cu"), b.column("cv")], ["u", "v"]).filter(ok)

    late = stored(two.select("a", "b", "cu", "cv").mapInArrow(lean(verify), "u long, v long").distinct(), "late", scratch)
    if late.limit(1).count():
        joined = components(late.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    else:
        joined = stored(roots, "joined")
    cleared(spark, scratch)
    flat = classes.join(joined, classes.d1 == joined.node, "left").select("n", "d1", "d2", "least_id", F.coalesce("root", "d1").alias("root"))
    least = flat.groupBy(F.col("root").alias("root_")).agg(F.min("least_id").alias("component_id"))
    named = flat.join(least, flat.root == least.root_).select(F.col("n").alias("n_"), F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), "component_id", "root")
    out = rows.join(named, (rows.n == F.col("n_")) & (rows.d1 == F.col("d1_")) & (rows.d2 == F.col("d2_")), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "text_key", "root")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, all columns as they are, but of each component only one: that of the least id, rows without an id last.

    A document is an id and a text, so one id on two texts that do not link stays twice; ties of id within a component are
    taken by a hash of the text, and of rows equal in both one stays. Texts without words always stay.
    """
    found = stored(ngram_jaccard_classes(df, id_col, text_col, **options).where("n_shingles > 0"), "components")
    name = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key")
    first = found.groupBy(F.col("root").alias("root_")).agg(F.min(name).alias("first"), F.count("*").alias("rows_"))
    first = stored(first.where("rows_ > 1").drop("rows_"), "first")
    judged = found.join(sized(first), F.col("root") == F.col("root_")).select(F.col("id").alias("id_"), F.col("text_key").alias("key_"), (name == F.col("first")).alias("stays"))
    gone = sized(stored(judged.where("NOT stays").drop("stays").distinct(), "gone"))
    several = stored(judged.where("stays").groupBy("id_", "key_").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    packed = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), df[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(df[f"`{text_col}`"].cast("string")).alias("text_key"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))
    kept = packed.join(gone, same, "left_anti")
    if several.limit(1).count():
        several = sized(several)
        kept = kept.join(several, same, "left_anti").unionByName(kept.join(several, same, "left_semi").dropDuplicates(["id", "text_key"]))
    return kept.select("row.*")
