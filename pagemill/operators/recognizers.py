"""Recognisers as column builders, and pages of regions made into predictions.

A recogniser maps (image bytes, region text) to struct<text,score,metadata>. The two built-in ones need no pixels; a model is
added by register() with an Arrow UDF of the same result type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<text:string,score:double,metadata:map<string,string>>"
Recognizer = Callable[[Column, Column], Column]
_known: dict[str, Recognizer] = {}


def register(name: str, recognizer: Recognizer) -> None:
    _known[name] = recognizer


def recognizer(name: str) -> Recognizer:
    if name not in _known:
        raise ValueError(f"no recogniser {name!r}; there are {sorted(_known)}")
    return _known[name]


def _result(text: Column, score: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), score.cast("double").alias("score"), F.create_map().cast("map<string,string>").alias("metadata"))


register("empty", lambda image, text: _result(F.lit(""), F.lit(None)))
register("oracle", lambda image, text: _result(F.coalesce(text, F.lit("")), F.lit(1.0)))


Model = Callable[[list[bytes], list[str | None]], Sequence[tuple[str, float | None]]]
_ARROW = pa.struct([("text", pa.string()), ("score", pa.float64()), ("metadata", pa.map_(pa.string(), pa.string()))])


def padded_batches(sizes: Sequence[int], budget: int) -> list[list[int]]:
    """Positions cut into batches of like sizes, the largest first: number times largest size is at most the budget, or the batch is one row."""
    out: list[list[int]] = []
    room = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if not out or not room:
            out.append([])
            room = max(1, budget // max(sizes[k], 1))
        out[-1].append(k)
        room -= 1
    return out


def in_batches(load: Callable[[], Model], budget: int = 1 << 24, size: Callable[[bytes], int] = len) -> Recognizer:
    """A recogniser from a model that takes lists of images and texts and gives (text, score) for each.

    `load` makes the model, once a task (an iterator UDF); rows are put into batches of like size, padded to at most `budget`
    (by `size`, say width times height of an image), and come back in their own places. A row without an image is not shown to
    the model: empty text, no score. A model that gives another number of results raises.
    """

    def run(chunks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = load()
        for images, texts in chunks:
            texts = texts.to_pylist()
            at = np.flatnonzero(np.asarray(images.is_valid())).tolist()
            pixels = [images[k].as_py() for k in at]
            out: list[tuple[str, float | None]] = [("", None)] * len(texts)
            for batch in padded_batches([size(p) for p in pixels], budget):
                found = model([pixels[k] for k in batch], [texts[at[k]] for k in batch])
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} results for {len(batch)} images")
                for k, result in zip(batch, found, strict=True):
                    out[at[k]] = result
            yield pa.array([{"text": t, "score": s, "metadata": []} for t, s in out], _ARROW)

    run.__annotations__ = {"chunks": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, RESULT)
    return lambda image, text: udf(image, text.cast("string"))


def recognize(regions: DataFrame, name: str, image: str = "image", text: str = "text") -> DataFrame:
    """Adds predicted_text and score; image and graph regions are not read: empty text, no score."""
    skip = F.coalesce(F.col("region_type").isin("image", "graph"), F.lit(False))
    pixels = F.when(~skip, F.col(image)) if image in regions.columns else F.lit(None).cast("binary")
    r = F.when(~skip, recognizer(name)(pixels, F.col(text)))
    return regions.withColumn("__r", r).withColumns({"predicted_text": F.when(skip, "").otherwise(F.col("__r.text")), "score": F.col("__r.score")}).drop("__r")


def oracle_detections(regions: Column) -> Column:
    """Annotated regions as detections of score 1.0."""
    return F.transform(regions, lambda r: F.struct(r.bbox.alias("bbox"), r.type.alias("type"), F.lit(1.0).alias("score")))
