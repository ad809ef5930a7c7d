"""Matching blocks of pairs of texts: the longest common block (ties: first in one, then first in the other), then the same left and right of it.

Short pairs are taken many at a time. All maximal runs of two and more equal characters on the diagonals of all pairs are found by
comparing each text with the other; a level of the recursion picks every part's longest run and clips the others to the parts
left and right of it, so a run is touched once a level. A single equal character, of which most runs consist, is a block only in
what these leave: it is looked for in the gaps between them alone. Long parts, of over CELLS cells, are first cut by their longest
block, found in linear time by a suffix automaton of the one text that the other is read through; a part that is small enough
joins the short ones.
"""

from __future__ import annotations

import numpy as np

#: Cells, a character of one text against one of the other, that are compared at once: a byte each, and some bytes a run.
CELLS = 1 << 20


class Automaton:
    """Every substring of a text by its states, each with the place where it first ends."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            new = self._state({}, self.length[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 < self.length[q]:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q], q = twin, twin
                self.link[new] = q
            last = new

    def _state(self, following: dict[str, int], length: int, first: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def longest_block(self, other: str) -> tuple[int, int, int]:
        """(start here, start there, size) of the longest common block; of equals the first here, then the first there."""
        best, state, size = (0, 0, 0), 0, 0
        for j, c in enumerate(other):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
                i = self.first[state] - size + 1
                if size > best[2] or size == best[2] and i < best[0]:
                    best = (i, j - size + 1, size)
        return best


def _flat(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)


def _runs(ones: list[str], twos: list[str]) -> tuple[np.ndarray, ...]:
    """(pair, start in one, start in two, size) of all maximal runs of two characters or more of pairs that are compared at once."""
    flat = [_flat(ones), _flat(twos)]
    kind = np.uint8 if max(f.max(initial=0) for f in flat) < 254 else np.int32

    def rows(codes: np.ndarray, texts: list[str], fill: int) -> np.ndarray:
        size = np.array([len(t) for t in texts])
        out = np.full((len(texts), max(1, size.max())), fill, kind)
        out[np.arange(out.shape[1]) < size[:, None]] = codes
        return out

    one, two = rows(flat[0], ones, 254 if kind is np.uint8 else -1), rows(flat[1], twos, 255 if kind is np.uint8 else -2)
    n, m = one.shape[1], two.shape[1]
    equal = one[:, :, None] == two[:, None, :]
    both = equal[:, :-1, :-1] & equal[:, 1:, 1:]
    start = both.copy()
    start[:, 1:, 1:] &= ~both[:, :-1, :-1]
    pair, rest = np.divmod(np.flatnonzero(start), max(1, (n - 1) * (m - 1)))
    i, j = np.divmod(rest, max(1, m - 1))
    size = np.full(len(pair), 2)
    at = np.arange(len(pair))
    while len(at):
        x, y = i[at] + size[at], j[at] + size[at]
        inside = (x < n) & (y < m)
        at, x, y = at[inside], x[inside], y[inside]
        at = at[equal[pair[at], x, y]]
        size[at] += 1
    return pair, i, j, size


def _cut(pair: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, wide: int, least: int) -> tuple[np.ndarray, ...]:
    """(pair, start in one, start in two, size) of the blocks of `least` characters or more; pair: of each part, the others: of each run."""
    found, wide = [], np.int64(wide)
    while len(part):
        key = (size * wide + (wide - 1 - i)) * wide + (wide - 1 - j)  # the longest, then the first in one, then in two
        best = np.full(len(pair), -1, np.int64)
        np.maximum.at(best, part, key)
        on = best >= 0
        k, bj = np.divmod(best, wide)
        k, bi = np.divmod(k, wide)
        bi, bj = wide - 1 - bi, wide - 1 - bj
        found.append((pair[on], bi[on], bj[on], k[on]))
        bi, bj, k = bi[part], bj[part], k[part]
        left = np.minimum(np.minimum(size, bi - i), bj - j)  # what of a run lies before the block in both texts
        skip = np.maximum(np.maximum(bi + k - i, bj + k - j), 0)  # and what lies behind it
        l, r = left >= least, size - skip >= least
        part = np.concatenate([2 * part[l], 2 * part[r] + 1])
        i, j, size = np.concatenate([i[l], (i + skip)[r]]), np.concatenate([j[l], (j + skip)[r]]), np.concatenate([left[l], (size - skip)[r]])
        used = np.zeros(2 * len(pair), bool)
        used[part] = True
        pair, part = np.repeat(pair, 2)[used], (np.cumsum(used) - 1)[part]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _gaps(pair: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, start in one, start in two, lost, new) before each block and from the last one to the end, by pair and place; the
    blocks of a pair come in order of place. With the sizes of the blocks that end the gaps."""
    n = len(sizes)
    order = np.argsort(np.concatenate([pair, np.arange(n)]), kind="stable")
    pair, i, j, size = (np.concatenate(c)[order] for c in ((pair, np.arange(n)), (i, sizes[:, 0]), (j, sizes[:, 1]), (size, np.zeros(n, np.int64))))
    fresh = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
    from_i, from_j = (np.where(fresh, 0, np.r_[0, (x + size)[:-1]][: len(x)]) for x in (i, j))
    return pair, from_i, from_j, i - from_i, j - from_j, size


def _short_blocks(ones: list[str], twos: list[str], runs: tuple[np.ndarray, ...], cells: int) -> tuple[np.ndarray, ...]:
    """(pair, start in one, start in two, size) of the blocks of short pairs, from their runs of two characters or more."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(ones, twos, strict=True)], np.int64)
    wide = int(sizes.max()) + 1
    pair, i, j, size = _cut(np.arange(len(ones)), *runs, wide, 2)
    order = np.lexsort((i, pair))
    found = [(pair[order], i[order], j[order], size[order])]
    pair, from_i, from_j, lost, new, _ = _gaps(*found[0], sizes)
    open_ = np.flatnonzero((lost > 0) & (new > 0))
    pair, from_i, from_j, lost, new = (x[open_] for x in (pair, from_i, from_j, lost, new))
    area, start, flat = np.cumsum(lost * new), np.cumsum(sizes, 0) - sizes, (_flat(ones), _flat(twos))
    lo = 0
    while lo < len(pair):  # as many gaps as the cells allow
        hi = max(lo + 1, int(np.searchsorted(area, (area[lo - 1] if lo else 0) + cells, side="right")))
        here = lost[lo:hi] * new[lo:hi]
        gap = np.repeat(np.arange(hi - lo), here)
        x, y = np.divmod(np.arange(len(gap)) - np.repeat(np.cumsum(here) - here, here), new[lo:hi][gap])
        x, y = x + from_i[lo:hi][gap], y + from_j[lo:hi][gap]
        of = pair[lo:hi][gap]
        same = np.flatnonzero(flat[0][start[of, 0] + x] == flat[1][start[of, 1] + y])
        found.append(_cut(pair[lo:hi], gap[same], x[same], y[same], np.ones(len(same), np.int64), wide, 1))
        lo = hi
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def matching_blocks(ones: list[str], twos: list[str], cells: int = CELLS) -> tuple[np.ndarray, ...]:
    """(pair, start in one, start in two, size) of all blocks, by pair and place."""
    found, parts = [], []
    todo = [(k, 0, len(a), 0, len(b)) for k, (a, b) in enumerate(zip(ones, twos, strict=True))]
    while todo:
        k, alo, ahi, blo, bhi = todo.pop()
        if ahi == alo or bhi == blo:
            continue
        if (ahi - alo) * (ahi - alo + bhi - blo) <= cells:
            parts.append((k, alo, ahi, blo, bhi))
            continue
        i, j, size = Automaton(ones[k][alo:ahi]).longest_block(twos[k][blo:bhi])
        if size:
            found.append(tuple(np.array([x]) for x in (k, alo + i, blo + j, size)))
            todo += [(k, alo, alo + i, blo, blo + j), (k, alo + i + size, ahi, blo + j + size, bhi)]
    parts.sort(key=lambda p: (p[2] - p[1], p[4] - p[3]))
    at, first, runs, held = 0, 0, [], 0
    cut = lambda lo, hi: ([ones[k][a:b] for k, a, b, _, _ in parts[lo:hi]], [twos[k][a:b] for k, _, _, a, b in parts[lo:hi]])
    while at < len(parts):  # pairs of about one size, as many as the cells allow
        to, wide = at, 0
        while to < len(parts):
            n, m = parts[to][2] - parts[to][1], parts[to][4] - parts[to][3]
            wide = max(wide, m)
            if to > at and (to + 1 - at) * n * (n + wide) > cells:
                break
            to += 1
        pair, i, j, size = _runs(*cut(at, to))
        runs.append((pair + at - first, i, j, size))
        held += len(pair)
        at = to
        if held > cells or at == len(parts):  # the recursion takes many pairs more, as their runs are few
            group = np.array(parts[first:at])
            pair, i, j, size = _short_blocks(*cut(first, at), tuple(np.concatenate(c) for c in zip(*runs, strict=True)), cells)
            found.append((group[pair, 0], i + group[pair, 1], j + group[pair, 3], size))
            first, runs, held = at, [], 0
    pair, i, j, size = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else [()] * 4))
    order = np.lexsort((i, pair))
    return pair[order], i[order], j[order], size[order]


def edit_counts(ones: list[str], twos: list[str], cells: int = CELLS) -> np.ndarray:
    """Of each pair: insertions, deletions, substitutions, equal characters and Cyrillic ones put for each other.

    Between two blocks, what stands in one text only is deleted, in the other only inserted; where both have something, the longer
    counts as substituted, and characters are held against each other from the front.
    """
    n = len(ones)
    pair, i, j, size = matching_blocks(ones, twos, cells)
    sizes = np.array([[len(a), len(b)] for a, b in zip(ones, twos, strict=True)], np.int64).reshape(-1, 2)
    pair, from_i, from_j, lost, new, size = _gaps(pair, i, j, size, sizes)
    both = (lost > 0) & (new > 0)
    out = np.zeros((n, 5), np.int64)
    for k, x in enumerate((np.where(lost == 0, new, 0), np.where(new == 0, lost, 0), np.where(both, np.maximum(lost, new), 0), size)):
        np.add.at(out[:, k], pair, x)
    held = np.where(both, np.minimum(lost, new), 0)
    spot = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    flat = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (ones, twos)]
    start = np.cumsum(sizes, 0) - sizes
    x, y = (text[np.repeat(s[pair] + f, held) + spot] for text, s, f in zip(flat, start.T, (from_i, from_j), strict=True))
    cyrillic = (x != y) & (x >= 0x400) & (x <= 0x4FF) & (y >= 0x400) & (y <= 0x4FF)
    np.add.at(out[:, 4], np.repeat(pair, held)[cyrillic], 1)
    return out
