"""Coarse text boxes of an image: local threshold, closing by rectangles, outer components, rules on size and place. Numpy only.

Images are independent rows, read one at a time within an Arrow batch; one that can't be read has no boxes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.images import decode_png

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")])
DETECTION = T.StructType([T.StructField("bbox", BOX), T.StructField("type", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
# fixed values: luma of red, green and blue; the smoothing kernel; width and offset of the local threshold
LUMA = (0.299, 0.587, 0.114)
SMOOTH = np.array([1, 4, 6, 4, 1]) / 16
WINDOW, OFFSET = 41, 11


@dataclass(frozen=True)
class BoxRules:
    """Which boxes count, as pixels or shares of the image."""

    min_area: int = 500
    max_area_share: float = 0.35
    kernel_width_share: float = 0.045
    kernel_height_share: float = 0.012
    min_width: int = 12
    min_height: int = 8
    edge: int = 2
    thin_share: float = 0.035


def _weighted(image: np.ndarray, kernel: np.ndarray, border: str) -> np.ndarray:
    half = len(kernel) // 2
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(image, pad, mode=border)
        image = sum(w * np.take(wide, np.arange(k, k + image.shape[axis]), axis) for k, w in enumerate(kernel))
    return image


def ink(pixels: np.ndarray) -> np.ndarray:
    """True where a pixel is darker than its surroundings."""
    grey = np.rint(pixels @ np.array(LUMA))
    if min(grey.shape) > len(SMOOTH) // 2:
        grey = np.rint(_weighted(grey, SMOOTH, "reflect"))
    at = np.arange(WINDOW) - WINDOW // 2
    bell = np.exp(-(at**2) / (2 * (0.3 * ((WINDOW - 1) * 0.5 - 1) + 0.8) ** 2))
    return grey <= np.rint(_weighted(grey, bell / bell.sum(), "edge")) - OFFSET


def _spread(mask: np.ndarray, width: int, height: int, grow: bool) -> np.ndarray:
    """Dilate or erode by a rectangle: sums over a sliding window, so the cost does not depend on its size."""
    for axis, k in ((1, width), (0, height)):
        pad = [(k // 2, k - 1 - k // 2) if a == axis else (0, 0) for a in (0, 1)]
        total = np.cumsum(np.pad(mask, pad, constant_values=not grow), axis=axis, dtype=np.int32)
        total = np.insert(total, 0, 0, axis=axis)
        n = mask.shape[axis]
        window = np.take(total, np.arange(k, k + n), axis) - np.take(total, np.arange(n), axis)
        mask = window > 0 if grow else window == k
    return mask


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last + 1 column of every run of true pixels, row by row."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, first = np.nonzero(edge == 1)
    return y, first, np.nonzero(edge == -1)[1]


def outer_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the 8-connected components that are not enclosed by another one."""
    field = np.pad(mask, 1)  # a margin of background, which is the outside
    kinds = [_runs(field), _runs(~field)]
    up = list(range(sum(len(k[0]) for k in kinds)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    base = 0
    for (y, a, b), reach in zip(kinds, (1, 0), strict=True):  # ink touches at corners, background does not
        rows = np.searchsorted(y, np.arange(field.shape[0] + 1))
        for r in range(1, field.shape[0]):
            i, j = int(rows[r - 1]), int(rows[r])
            while i < rows[r] and j < rows[r + 1]:
                if a[i] < b[j] + reach and a[j] < b[i] + reach:
                    up[root(base + i)] = root(base + j)
                if b[i] < b[j]:
                    i += 1
                else:
                    j += 1
        base += len(y)
    (y, a, b), (gy, ga, gb) = kinds
    n, outside = len(y), root(len(y))
    open_ = np.zeros(field.shape, bool)
    for k in range(len(gy)):
        if root(n + k) == outside:
            open_[gy[k], ga[k] : gb[k]] = True
    boxes: dict[int, list[int]] = {}
    seen: set[int] = set()
    for k in range(n):
        r, box = root(k), (int(a[k]) - 1, int(y[k]) - 1, int(b[k]) - 1, int(y[k]))
        old = boxes.setdefault(r, list(box))
        old[:] = [min(old[0], box[0]), min(old[1], box[1]), max(old[2], box[2]), max(old[3], box[3])]
        if open_[y[k], a[k] - 1] or open_[y[k], b[k]] or open_[y[k] - 1, a[k] : b[k]].any() or open_[y[k] + 1, a[k] : b[k]].any():
            seen.add(r)
    return [tuple(v) for r, v in boxes.items() if r in seen]


def text_boxes(pixels: np.ndarray, rules: BoxRules = BoxRules()) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2) in order of y1, x1, x2, y2."""
    height, width = pixels.shape[:2]
    mask, kernel = ink(pixels), (max(15, int(width * rules.kernel_width_share)), max(5, int(height * rules.kernel_height_share)))
    for grow in (True, True, False, False):
        mask = _spread(mask, *kernel, grow)
    found = []
    for x1, y1, x2, y2 in outer_boxes(_spread(mask, 5, 5, True)):
        w, h = x2 - x1, y2 - y1
        on_edge = min(x1, y1) <= rules.edge or x2 >= width - rules.edge or y2 >= height - rules.edge
        thin = h < height * rules.thin_share or w < width * rules.thin_share
        if rules.min_area <= w * h <= width * height * rules.max_area_share and w >= rules.min_width and h >= rules.min_height and not (on_edge and thin):
            found.append((x1, y1, x2, y2))
    return sorted(found, key=lambda b: (b[1], b[0], b[2], b[3]))


@F.pandas_udf(T.ArrayType(DETECTION))
def detect_text(content: pd.Series) -> pd.Series:
    """Detections of type text without a score for each PNG."""
    out = []
    for data in content:
        pixels = decode_png(None if data is None else bytes(data))
        out.append([] if pixels is None else [(b, "text", None, {"detector": "numpy"}) for b in text_boxes(pixels)])
    return pd.Series(out, dtype=object)
