"""Pixels without an image library: PNG in and out by zlib and numpy, sizes from file heads, crops beside their manifest.

Read are PNG files of 8 bits a sample, not interlaced, of any colour type; other kinds give null pixels and keep their size where
the head names it (PNG and JPEG). Alpha is dropped, grey and palettes become RGB.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.files import write_files

MAGIC = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def encode_png(pixels: np.ndarray) -> bytes:
    """An RGB image (height, width, 3) of bytes, unfiltered."""
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + width * 3), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _chunks(data: bytes):
    at = len(MAGIC)
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the five line filters; only the average and Paeth filters need a pass over pixels."""
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1), np.uint8)
    for y, line in enumerate(lines):
        kind, row, up = line[0], line[1:].copy(), out[y]
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += up
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for x in range(0, len(row), step):
                above = up[x : x + step].astype(np.int64)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
                    guess = np.choose(far.argmin(0), [left, above, corner])  # the first of equals: left, above, corner
                left, corner = (row[x : x + step] + guess) % 256, above
                row[x : x + step] = left
        out[y + 1] = row
    return out[1:]


def decode_png(data: bytes | None) -> np.ndarray | None:
    """RGB pixels, or None where this is no PNG of the kinds read here."""
    if not data or data[:8] != MAGIC:
        return None
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts[name] = parts.get(name, b"") + body if name == b"IDAT" else body
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or laced or colour not in SAMPLES:
        return None
    step = SAMPLES[colour]
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * step)
    pixels = _unfiltered(lines, step).reshape(height, width, step)
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return pixels[:, :, :3] if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def head_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) as a PNG or JPEG head names them."""
    data = bytes(data or b"")
    if data[:8] == MAGIC and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([head_size(x) or (None, None) for x in content], columns=["width", "height"]).astype("Int32")


@F.pandas_udf(T.BinaryType())
def crop_png(content: pd.Series, box: pd.DataFrame) -> pd.Series:
    """The pixels of a box (x1, y1, x2, y2, already padded and clamped) as a PNG; null where the image can't be read or nothing is left."""
    out, last, pixels = [], None, None
    for data, x1, y1, x2, y2 in zip(content, box["x1"], box["y1"], box["x2"], box["y2"], strict=True):
        if data is not last:  # regions of one page follow each other
            last, pixels = data, decode_png(None if data is None else bytes(data))
        whole = pixels is not None and not any(pd.isna(v) for v in (x1, y1, x2, y2))
        cut = pixels[max(0, int(y1)) : int(y2), max(0, int(x1)) : int(x2)] if whole else None
        out.append(encode_png(cut) if cut is not None and cut.size else None)
    return pd.Series(out, dtype=object)


def outlined(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], colours: list[tuple[int, int, int]], width: int = 2) -> np.ndarray:
    """A copy with the frame of each box drawn inside it; later boxes cover earlier ones, parts off the image are cut."""
    out = pixels.copy()
    for (x1, y1, x2, y2), colour in zip(boxes, colours, strict=True):
        x1, y1 = max(0, x1), max(0, y1)
        for part in (out[y1 : min(y1 + width, y2), x1:x2], out[max(y1, y2 - width) : y2, x1:x2], out[y1:y2, x1 : min(x1 + width, x2)], out[y1:y2, max(x1, x2 - width) : x2]):
            part[:] = colour
    return out


@F.pandas_udf(T.BinaryType())
def overlay_png(content: pd.Series, boxes: pd.Series, colours: pd.Series) -> pd.Series:
    """PNG of an image with boxes (array of x1, y1, x2, y2) in colours (array of RGB hex) drawn on it; null where it can't be read."""
    out = []
    for data, own, named in zip(content, boxes, colours, strict=True):
        pixels = decode_png(None if data is None else bytes(data))
        if pixels is None:
            out.append(None)
            continue
        some = [] if own is None else [tuple(int(b[c]) for c in ("x1", "y1", "x2", "y2")) for b in own]
        out.append(encode_png(outlined(pixels, some, [tuple(bytes.fromhex(c)) for c in (named if some else [])])))
    return pd.Series(out, dtype=object)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content, width, height of all images under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", image_size("content").alias("s")).select("path", "content", "s.*")


def write_crops(crops: DataFrame, root: str, path: str = "crop_path", content: str = "png") -> int:
    """Each crop as root/crop_path, by a writer that commits; returns how many were written."""
    return write_files(crops, root, path, content)["files"]
