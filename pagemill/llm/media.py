"""Media columns: texts as 8-bit WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

encode() writes bytes, padded by 255 to a positive multiple of 576, as 8-bit mono samples with the wave module; decode()
reads them back without loss. Frames of 576 samples, centred on every HOP-th sample from the first to the end (silence is
added beyond both), are windowed and transformed, so one block of 576 bytes gives five frames; in each frame the
strongest local maximum of each of `bands` frequency bands (a bin above its left and not below its right neighbour, also
across the border of a band; the lowest of equals) is a peak if it lies above the band's mean. A frame's own mean is taken off
before, so loud padding does not hide a short text. A peak is paired with the peaks of the next `reach` frames; each pair gives a time-coded entry:
frame << 32 | (band peak, later peak, gap). All frames of all samples are used.

A null text is an empty one: one block of 255. Equal texts give equal values; repeated rows are each encoded, null ids are
carried through. Very long texts are encoded whole; their frames are transformed some at a time. Columns beside id and text
are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import keyed, lean, slices

FRAME, HOP, RATE = 576, 144, 8000
CHUNK = 2048


def encode(data: bytes) -> bytes:
    """A WAV file of the padded bytes."""
    padded = data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(padded)
    return out.getvalue()


def decode(stored: bytes) -> bytes:
    """The sample bytes of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray, bands: int = 4) -> np.ndarray:
    """Per frame and band the strongest local maximum, or -1 where none stands out; frames are transformed in chunks."""
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(samples, FRAME // 2, constant_values=128), FRAME)[::HOP]
    out = np.empty((len(frames), bands), np.int64)
    width = (FRAME // 2) // bands
    for k in range(0, len(frames), CHUNK):
        x = frames[k : k + CHUNK].astype(np.float32)
        x = (x - x.mean(1, keepdims=True)) * _WINDOW
        full = np.abs(np.fft.rfft(x, axis=1))
        power = full[:, 1 : 1 + width * bands]
        top = power > full[:, : width * bands]
        right = full[:, 2 : 2 + width * bands]  # nothing lies beyond the last bin
        top[:, : right.shape[1]] &= power[:, : right.shape[1]] >= right
        cut = power.reshape(len(x), bands, width)
        tops = np.where(top, power, -1).reshape(len(x), bands, width)
        at = tops.argmax(2)
        high = np.take_along_axis(tops, at[:, :, None], 2)[:, :, 0]
        out[k : k + CHUNK] = np.where(high > cut.mean(2) + 1e-3, at + np.arange(bands) * width, -1)
    return out


def fingerprints(samples: np.ndarray, bands: int = 4, reach: int = 3) -> np.ndarray:
    """Time-coded pairs of peaks, in order of time."""
    p = peaks(samples, bands)
    n = len(p)
    late = np.full((n, bands, reach), -1, np.int64)  # per frame and band the peaks of the next frames
    for gap in range(1, reach + 1):
        q = p[gap:]
        late[: n - gap, :, gap - 1] = np.where(q >= 0, (q << 8) | gap, -1)
    late.sort(axis=2)  # bands do not overlap: frame, earlier band, later band and these are in order of the codes
    early, late = p[:, :, None, None], late[:, None]
    code = (np.arange(n)[:, None, None, None] << 32) | (early << 20) | late
    return code[(early >= 0) & (late >= 0)]


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """id, n_bytes, media (WAV), payload digests read back from it, media digests and the fingerprint array."""
    docs = keyed(df, id_col, text_col)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprints", "media"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for i, x in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (x or "").encode("utf-8", "surrogatepass")
                wav = encode(data)
                payload = decode(wav)
                prints = fingerprints(np.frombuffer(payload, np.uint8))
                feature = f"{len(prints)}:{hashlib.md5(prints.tobytes()).hexdigest()}"
                rows.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, prints if keep_media else None, wav if keep_media else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    out = docs.mapInArrow(lean(run), "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprints array<long>, media binary")
    return out.withColumnRenamed("id", id_col) if keep_media else out.drop("fingerprints", "media").withColumnRenamed("id", id_col)
