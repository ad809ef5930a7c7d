"""Texts as streams of lower-cased letters: everything else is one blank between words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TOP = 0x20000
_tables: list[np.ndarray] = []


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        letter, lower = np.zeros(_TOP, bool), np.arange(_TOP, dtype=np.uint32)
        for c in range(_TOP):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                if len(y := x.lower()) == 1:
                    lower[c] = ord(y)
        lower[~letter] = 32
        _tables[:] = [letter, lower]
    return _tables[0], _tables[1]


def letter_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (32: a blank), each text's start in them, n + 1, and whether it has a letter. Each text begins and ends with a blank."""
    letter, lower = _lookup()
    texts = [" " + (x or "") + " " for x in column.to_pylist()]
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.r_[0, np.cumsum([len(x) for x in texts])]
    far = cp >= _TOP  # ideographs beyond the tables are letters as they stand
    low = lower[np.where(far, 32, cp)]
    if far.any():
        low[far] = cp[far]
    blank = low == 32
    first = np.zeros(len(cp), bool)
    first[at[:-1]] = True
    drop = np.zeros(len(cp), bool)
    drop[1:] = blank[1:] & blank[:-1] & ~first[1:]
    kept = np.r_[0, np.cumsum(~drop)]
    start = kept[at]
    stream = low[~drop]
    has = np.diff(start) > 1
    return stream, start, has
