"""Plain models of the operators, small and slow."""

import re
from collections import Counter, defaultdict
from math import log, log10
from zlib import crc32

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(rows, threshold=75):
    """rows: (id, text). A node is a row; its label the least id among the rows that it reaches. None where none has an id."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(s), (min(least[root(k)], default=None) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def suffix_scores(rows, depth=5, divergence=2.0, min_count=2, r=50.0, m=3.0, head_words=60_000):
    """(id, held, tokens, known, N, base, score) of each row, and the distribution of a context by name."""
    docs = [(i, ["<BEGIN>", *words(t), "<END>"], i is not None and crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c, cx, after = Counter(), Counter(), defaultdict(list)
    for _, w, held in docs:
        for k in range(1, len(w) if not held else 0):
            for n in range(min(k, depth) + 1):
                s = tuple(w[k - n : k])
                c[s] += 1
                if not cx[s, w[k]]:
                    after[s].append(w[k])
                cx[s, w[k]] += 1
    n, v = c[()], len(after[()])
    by, head = Counter(cx[(), x] for x in after[()] if x != "<END>"), set()
    for level in sorted(by, reverse=True):
        if len(head) + by[level] > head_words:
            break
        head |= {x for x in after[()] if x != "<END>" and cx[(), x] == level}
    tail = [x for x in after[()] if x not in head and x != "<END>"]
    even = sum(cx[(), x] for x in tail) / len(tail) / n if tail else 0

    def seen(s, x):
        return cx[s, x] / c[s] if s else (even if x in tail else cx[(), x] / n)

    tail, state, alive = set(tail), {(): ()}, {()}
    for s in sorted((s for s in c if s), key=len):
        of = state[s[1:]]
        gain = sum(cx[s, x] * (log(cx[s, x] / c[s]) - log(seen(of, x))) for x in after[s]) if c[s] >= min_count else 0
        ok = s[1:] in alive and c[s] >= min_count
        if ok:
            alive.add(s)
        state[s] = s if ok and gain >= divergence else of

    def chance(context, x):
        p, above = (cx[(), x] + 1) / (n + v + 1), r
        for k in range(1, min(len(context), depth) + 1):
            s = context[len(context) - k :]
            if s and state.get(s) == s:
                p, above = (cx[s, x] + above * p) / (c[s] + above), m
        return p

    out = []
    for i, w, held in docs:
        own = [chance(tuple(w[max(0, k - depth) : k]), w[k]) for k in range(1, len(w))]
        out.append((i, held, len(w) - 1, sum(cx[(), x] > 0 for x in w[1:]), n, sum(log10((cx[(), x] + 1) / (n + v + 1)) for x in w[1:]), sum(map(log10, own))))
    return out, chance, after[()], max((len(s) for s in state if state[s] == s), default=0)
