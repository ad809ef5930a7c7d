"""Operators 11 to 13 against written-out versions."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from math import floor, log
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from conftest import SCHEMA, sentence
from models import LOW

from pagemill.llm import alignment, ann, importance, postings

TOKENIZERS = Path("/opt/tokenizers")


# 11 importance resampling ------------------------------------------------------------------------------------------
def runs_of(text):
    import re

    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def resampled(docs, target, buckets=10_000, share=25, shortest=20):
    """docs, target: (id, text). (id, n_features, weight, score, rank) of each row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in runs_of(x)[1]) for rows in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        w, f = runs_of(x)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in out if r[5] >= shortest and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[5], r[2]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return out


none_first = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


def test_crcs_of_runs_and_pairs():
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 200]))) for _ in range(200)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    one = importance.run_crcs(data, ends - [len(w) for w in words], ends)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    two = importance.joined_crcs(one[:-1], one[1:], np.array([len(w) for w in words[1:]]))
    assert two.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("cell", [postings.CELL_BYTES, 2000])
def test_resampling_is_the_written_one(spark, some, monkeypatch, cell):
    """Also with every range cut into many cells."""
    monkeypatch.setattr(postings, "CELL_BYTES", cell)
    monkeypatch.setattr(importance, "SLICE", 10_000)
    docs = [(r[0], r[1]) for r in some.collect()]
    target = [(k, docs[7 * k][1]) for k in range(9)] + [(9, None)]
    got = importance.importance_resample(some, spark.createDataFrame(target, "item_id long, text string")).collect()
    assert none_first(got) == none_first(resampled(docs, target))
    assert sum(r["rank"] is not None for r in got) > 20


def test_resampling_edges(spark, edge, nothing):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = importance.importance_resample(edge, nothing).collect()
    assert none_first(got) == none_first(resampled(docs, []))
    assert importance.importance_resample(nothing, edge).count() == 0


def test_resampling_repeats(spark):
    """A third of all rows is one row: each repeat counts in the corpus and takes a rank of its own."""
    rng = random.Random(4)
    rows = [(1, sentence(rng, 30))] * 900 + [(k, sentence(rng, 25)) for k in range(2, 1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = [(0, rows[0][1])]
    got = importance.importance_resample(df, spark.createDataFrame(target, "item_id long, text string")).collect()
    assert none_first(got) == none_first(resampled(rows, target))


# 12 additive quantisation -------------------------------------------------------------------------------------------
def brute(rows, top=20):
    """rows: (id, vector); usable ones of distinct id and vector."""
    out = {}
    for i in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for q in (v for j, v in rows if j == i):
            for j, v in rows:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(np.dot(q, v)))
        out[i] = sorted(((-s, j) for j, s in best.items()))[:top]
    return out


def check_recall(got, want, least):
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists[r["query_id"]].append(r)
    assert set(lists) == {i for i, x in want.items() if x}
    for i, x in lists.items():
        assert [r["rank"] for r in x] == list(range(1, len(want[i]) + 1))
        assert [(-r["score"], r["vec_id"]) for r in x] == sorted((-r["score"], r["vec_id"]) for r in x)
    hits = sum(len({r["vec_id"] for r in lists[i]} & {j for _, j in x}) for i, x in want.items())
    assert hits >= least * sum(map(len, want.values()))
    return lists


def test_recall_by_codes(spark):
    """Clustered vectors of unequal norms, 4,000 in one part, so that the codes decide which 60 are reranked."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 24))) * rng.lognormal(0, 0.5, (4000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, pool=60, part_rows=10**6).collect()
    want = brute([(k, v) for k, v in enumerate(x)])
    lists = check_recall(got, want, 0.97)
    for i, found in lists.items():
        assert np.allclose([r["score"] for r in found], [x[i] @ x[r["vec_id"]] for r in found], rtol=1e-12)


def test_encoding_improves_on_greedy_codes():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x[:2000], books=6, words=32)
    error = lambda beam: ((sum(books[j][c] for j, c in enumerate(ann.encode(x[2000:], books, beam).T)) - x[2000:]) ** 2).sum(1).mean()
    assert error(8) < error(1) < 0.5


def test_search_edges(spark, nothing):
    hot = [1.0, 2.0, 0.0]
    rows = [(k, hot) for k in range(100, 500)]  # more equal vectors than a list holds
    rows += [(20, [1.0, 2.0, -0.0]), (40, [3.0, 1.0, 1.0]), (41, [0.0, 0.0, 9.0]), (60, [1.0, 1.0, 1.0]), (60, [0.0, -1.0, 4.0]), (60, [0.0, -1.0, 4.0]), (61, [-1.0, 0.5, 0.0])]
    bad = [(80, None), (0, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (64, [float("inf"), 1.0, 1.0]), (65, []), (66, [1.0]), (None, hot)]
    df = spark.createDataFrame([(i, v, -1, "x", 2) for i, v in rows + bad], "vec_id long, embedding array<float>, id long, vec string, part int")
    got = ann.nearest(df).collect()
    want = brute([(i, np.array(v)) for i, v in rows])
    lists = check_recall(got, want, 1)
    assert {i: [(-r["score"], r["vec_id"]) for r in x] for i, x in lists.items()} == want
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, -2.0)]
    assert ann.nearest(df.limit(0)).count() == 0


# 13 tokenizer alignment ---------------------------------------------------------------------------------------------
def aligned(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) from whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(str(TOKENIZERS / "byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=str(TOKENIZERS / "piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    entry = {i: t for t, i in one.get_vocab().items()}
    piece = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    found, links, pairs = [], [], Counter()
    for i, text in rows:
        found.append((i, 0, 0, 0, ""))
        links.append([])
        if not text:
            continue
        raw = (" " + text).encode()
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        xs, ys = [bytes(letters[c] for c in entry[k]) for k in a], [piece(two.id_to_piece(k)) for k in b]
        if b"".join(xs) != raw or b"".join(ys) != raw:
            continue
        groups, at, p, q, x, y = [], [[], []], 0, 0, len(xs[0]), len(ys[0])
        while True:
            links[-1].append((a[p], b[q]))
            at[0] += [p] if p not in at[0] else []
            at[1] += [q] if q not in at[1] else []
            if x == y:
                groups.append("|".join(",".join(str(ids[k]) for k in own) for ids, own in zip((a, b), at)))
                at = [[], []]
                if x == len(raw):
                    break
            left, right = x <= y, y <= x
            if left:
                p, x = p + 1, x + len(xs[p + 1])
            if right:
                q, y = q + 1, y + len(ys[q + 1])
        found[-1] = (i, len(a), len(b), len(groups), ";".join(groups))
        pairs.update(links[-1])
    top = defaultdict(int)
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return [(i, n_a, n_b, n_g, len(x), sum(pairs[k] == top[k[1]] for k in x), sum(pairs[k] for k in x), g) for (i, n_a, n_b, n_g, g), x in zip(found, links)]


ODD = ["a  b\n c  d", " leading", "trailing  ", "<|endoftext|> <s> <unk> <0x41>", "▁ piece", "tab\t x\r\n  y", "\x1c \x85 z", "no_space_" * 300, "\U0001f600 你好 กิ", "'s 't it's 12 3,4", "　 wide ᠎ s​ t", "x\x00 y", "é ﬁ Å", "  ", " "]


@pytest.mark.skipif(not TOKENIZERS.is_dir(), reason="no vocabularies")
@pytest.mark.parametrize("cell", [postings.CELL_BYTES, 2000])
def test_alignment_is_the_written_one(spark, some, edge, monkeypatch, cell):
    monkeypatch.setattr(postings, "CELL_BYTES", cell)
    monkeypatch.setattr(alignment, "SLICE", 20_000)
    df = edge.select("doc_id", "text").union(some.select("doc_id", "text")).union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    got = alignment.align_tokenizers(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256").collect()
    want = aligned(rows)
    assert none_first(r[:8] for r in got) == none_first(want)
    assert all(r[8] == (hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in got)
    assert sum(w[1] > 0 for w in want) > 300


def test_alignment_of_nothing(spark, nothing):
    assert alignment.align_tokenizers(nothing).count() == 0


def test_a_hot_pair_is_spread(spark, monkeypatch):
    """One pair in every document: its postings are cut into cells, and its count is the whole corpus's."""
    monkeypatch.setattr(postings, "CELL_BYTES", 500)
    monkeypatch.setattr(alignment, "SLICE", 1000)
    df = spark.createDataFrame([(k, "the " * 60) for k in range(400)], "doc_id long, text string")
    got = alignment.align_tokenizers(df).select("n_links", "n_best", "count_sum").distinct().collect()
    want = {w[4:7] for w in aligned([(k, "the " * 60) for k in range(400)])}
    assert {tuple(r) for r in got} == want


def test_pack_counts():
    doc, key = np.array([0, 0, 1, 2, 2, 2]), np.array([5, 5, 5, 9, 4, 9])
    found = {}
    for r, n, body in postings.pack(doc, key, 3, 4):
        gaps, runs, docs, counts = postings.opened(body)
        keys = np.repeat(np.cumsum(gaps) * 4 + r, runs)
        found |= {(int(k), int(d)): int(c) for k, d, c in zip(keys, docs, counts)}
        assert n == len(docs)
    assert found == {(5, 0): 2, (5, 1): 1, (9, 2): 2, (4, 2): 1}
