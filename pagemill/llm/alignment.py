"""Cross-tokenizer alignment: which tokens of two vocabularies overlap, in groups that no token spans, and how often corpus-wide.

Both tokenizers write the same bytes, a space and the text, so each token is an interval of bytes. The ends of the B tokens are a
static, sorted interval index; the bytes of each A token stab it by bisection, which gives the B tokens that overlap it (links).
A byte offset that no token of either side spans is a gap and ends a group. An id pair's count is the number of links that hold
it in the whole corpus; a link is best if its count is the highest of its B id (ties included).

A = byte-level BPE (the tokenizers library), its entries decoded to bytes; B = sentencepiece, U+2581 a space, <0xHH> a byte; neither
reads special tokens in texts. Neither vocabulary has an entry with a space behind a character that is not blank, and neither joins
across such a place, so texts are cut there into segments, each distinct segment of a slice is encoded and aligned once, and
its tokens, groups and links stand wherever it stands (a vocabulary with such an entry is met by whole texts as segments).
Pairs become inverted postings (pair, document, count) dealt by B id; see postings.

Texts that are null, empty or whose tokens of A or B do not spell out space and text have no tokens: zeros and ''. Repeated rows
count each, and null ids are carried through. Very long texts are aligned whole. Columns beside id and text are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import cleared, keyed, lean, slices, stored
from pagemill.llm.postings import KIND, answered, gathered, pack, slice_rows, totals

TOKENIZERS = "/opt/tokenizers"
RANGES = 32
SLICE = 4 << 20
A_IDS = 1 << 16
SEGMENT = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*(?: \Z)?")  # a lone space at the end stays with what is before
_ready: dict[bytes, tuple] = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level entries write for each byte: printable Latin ones stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _tokenizers(a: bytes, b: bytes):
    """Encoders of lists of texts, the bytes of every id of both, and whether texts can be cut into segments."""
    name = hashlib.sha256(a + b).digest()
    if name not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        import sentencepiece
        from tokenizers import Tokenizer

        byte_bpe = Tokenizer.from_str(a.decode())
        byte_bpe.encode_special_tokens = True
        letters = byte_letters()
        a_bytes = [b""] * byte_bpe.get_vocab_size()
        for token, i in byte_bpe.get_vocab().items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        b_bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(pieces.get_piece_size()) for p in [pieces.id_to_piece(i)]]
        if len(a_bytes) > A_IDS or (len(b_bytes) // RANGES + 1) * A_IDS * RANGES >= 1 << 31:
            raise ValueError("vocabularies of too many entries")
        cut = not any(re.search(r"\S ", x.decode(errors="replace")) for x in (*a_bytes, *b_bytes))
        encode_a = getattr(byte_bpe, "encode_batch_fast", byte_bpe.encode_batch)
        _ready[name] = lambda texts: [x.ids for x in encode_a(texts, add_special_tokens=False)], lambda texts: pieces.encode(texts, num_threads=1), a_bytes, b_bytes, cut
    return _ready[name]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that overlaps it and the one behind the last; both sides cover the same bytes, starts excluded."""
    starts = np.r_[a_ends[:1] * 0, a_ends[:-1]]
    return np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends, "left") + 1


class Segments:
    """Distinct segments, encoded and aligned together: whole (spelt out by both sides), counts, groups as written, pairs and where they start."""

    def __init__(self, texts: list[str], encode_a, encode_b, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        sides = [(encode_a(texts), a_bytes), (encode_b([t[1:] for t in texts]), b_bytes)]  # B adds the space by itself
        raw = [t.encode() for t in texts]
        self.whole = np.ones(len(texts), bool)
        for tokens, spelt in sides:
            if b"".join([spelt[i] for x in tokens for i in x]) != b"".join(raw) or any(sum([len(spelt[i]) for i in x]) != len(r) for x, r in zip(tokens, raw, strict=True)):
                self.whole &= np.array([b"".join([spelt[i] for i in x]) == r for x, r in zip(tokens, raw, strict=True)], bool)
        good = np.flatnonzero(self.whole)
        # side by side the segments cover the same bytes, and the end of each is a gap: all are aligned at once
        flat, ends, of = [], [], []
        for tokens, spelt in sides:
            mine = [tokens[k] for k in good]
            flat.append(np.fromiter((i for x in mine for i in x), np.int64))
            ends.append(np.cumsum(np.array([len(x) for x in spelt], np.int64)[flat[-1]]))
            of.append(np.repeat(good, [len(x) for x in mine]))
        first, behind = overlaps(*ends)
        n = behind - first
        link = np.repeat(np.arange(len(n)), n)
        with_ = np.arange(len(link)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        self.pairs = flat[0][link] * len(b_bytes) + flat[1][with_]
        _, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        self.counts = np.stack([np.bincount(x, minlength=len(texts)) for x in (*of, of[0][at_a], of[0][link])], 1)
        self.links = np.r_[0, np.cumsum(self.counts[:, 3])]
        one, two = ([str(i) for i in x.tolist()] for x in flat)
        p = q = 0
        groups = []
        for r, s in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append(f"{one[p] if r == p + 1 else ','.join(one[p:r])}|{two[q] if s == q + 1 else ','.join(two[q:s])}")
            p, q = r, s
        at = np.r_[0, np.cumsum(self.counts[:, 2])].tolist()
        self.groups = [";".join(groups[lo:hi]) for lo, hi in zip(at, at[1:])]


def _aligned(docs: DataFrame, a: bytes, b: bytes, keep: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, a_bytes, b_bytes, cut = _tokenizers(*shared.value)
        for batch in slices(batches, most=SLICE):
            number: dict[str, int] = {}
            texts = [[] if not t else SEGMENT.findall(" " + t) if cut else [" " + t] for t in batch.column("text").to_pylist()]
            at = [np.array([number.setdefault(s, len(number)) for s in t], np.int64) for t in texts]
            del texts
            own = Segments(list(number), encode_a, encode_b, a_bytes, b_bytes)
            number.clear()
            at = [x if own.whole[x].all() else x[:0] for x in at]
            held = np.repeat(np.arange(len(at)), [len(x) for x in at])
            flat = np.concatenate([*at, np.zeros(0, np.int64)])
            sums = np.zeros((len(at), 4), np.int64)
            np.add.at(sums, held, own.counts[flat])
            groups = [";".join([own.groups[k] for k in x.tolist()]) for x in at]
            # each segment's pairs, once for each document that holds it, as often as it does
            n = own.links[flat + 1] - own.links[flat]
            doc = np.repeat(held, n)
            pair = own.pairs[np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own.links[flat], n)]
            key = (pair % len(b_bytes)) // RANGES * (A_IDS * RANGES) + pair // len(b_bytes) * RANGES + pair % len(b_bytes) % RANGES
            columns = [batch.column("id"), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(4)), pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups])]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            facts = pa.RecordBatch.from_arrays([*columns, pa.array(groups)] if keep else columns, [*names, "groups"] if keep else names)
            yield slice_rows(facts, pack(doc, key, len(at), RANGES))

    return docs.mapInArrow(lean(run), KIND)


def best_and_count(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pair whether its count is its B id's highest, and its count. keys: (B id // RANGES, A id, B id % RANGES), all of a range."""
    _, b = np.unique(keys // (A_IDS * RANGES), return_inverse=True)
    top = np.zeros(b.max() + 1 if len(b) else 0, np.int64)
    np.maximum.at(top, b, counts[:, 0])
    return np.stack([(counts[:, 0] == top[b]).astype(np.int64), counts[:, 0]], 1)


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", keep_groups: bool = True) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum and, if kept, the written groups.

    The vocabulary files are read by the driver and broadcast (their size is fixed).
    """
    scratch: list[str] = []
    rows = stored(_aligned(keyed(df, id_col, text_col), Path(tokenizers, a).read_bytes(), Path(tokenizers, b).read_bytes(), keep_groups), "aligned")
    sums = stored(totals(rows), "pairs", scratch)
    facts = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (", groups string" if keep_groups else "")
    answers = stored(answered(rows, sums, best_and_count, RANGES), "answers")
    cleared(df.sparkSession, scratch)
    return gathered(rows, answers, facts, ["n_best", "count_sum"]).withColumnRenamed("id", id_col)
