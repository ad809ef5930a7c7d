"""Document graphs as nested columns: pages of regions with stable ids, hypotheses, coordinates and lineage, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.hashing import box_text, stable_id

LEGACY_REGION, LEGACY_PAGE = "legacy_region_prediction", "legacy_page_prediction"  # fixed values
FRAME = "original_image"  # fixed value
_ABSENT = {"score": "double", "language": "string", "legibility": "string", "source": "string", "annotation_source": "string"}


def best_text(hypotheses: Column, text: Column) -> Column:
    """Text of the hypothesis of lowest rank, the first of equals; the stored text where there is none."""
    ranked = F.array_sort(F.transform(hypotheses, lambda h, i: F.struct(h["rank"].alias("rank"), i.alias("i"), h["text"].alias("text"))))
    return F.when(F.size(hypotheses) > 0, F.get(ranked, 0)["text"]).otherwise(text)


def document_region(page: Column, region: dict[str, Column], index: Column) -> Column:
    """A region of a graph from the columns bbox, type and text and, where known, score, language, legibility and sources."""
    known = {k: region.get(k, F.lit(None)).cast(kind) for k, kind in _ABSENT.items()}
    region_id = stable_id("region", page, box_text(region["bbox"]), region["type"], index)
    confidence = F.struct(known["score"].alias("score"), F.lit(LEGACY_REGION).alias("source"), F.array().cast("array<string>").alias("uncertainty_flags"))
    hypothesis = F.struct(stable_id("ocr", region_id, region["text"]).alias("hypothesis_id"), region["text"].alias("text"), confidence.alias("confidence"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("source"))
    return F.struct(
        region_id.alias("region_id"), page.alias("page_id"), page.alias("image_id"), region["bbox"].alias("bbox"), region["type"].alias("region_type"), region["text"].alias("text"),
        F.struct(F.lit(FRAME).alias("frame"), region["bbox"].alias("bbox")).alias("source_coordinate"), confidence.alias("confidence"), F.array(hypothesis).alias("ocr_hypotheses"),
        *(known[k].alias(k) for k in ("language", "legibility", "source", "annotation_source")), F.array(region_id).alias("lineage"),
    )


def document_pages(pages: DataFrame, image: str = "image_id", regions: str = "regions") -> DataFrame:
    """Pages (image_id, width, height, regions array<struct<bbox,type,text,..>>) as document pages; nothing is shuffled."""
    fields = pages.schema[regions].dataType.elementType.names
    graph = F.transform(F.col(regions), lambda r, i: document_region(F.col(image), {k: r[k] for k in fields}, i))
    return pages.select(F.col(image).alias("page_id"), F.col(image).alias("image_id"), "width", "height", graph.alias("regions"), F.create_map(F.lit("source"), F.lit(LEGACY_PAGE)).alias("metadata"))


def page_predictions(documents: DataFrame) -> DataFrame:
    """Document pages as predictions again: the best hypothesis is the text, the image id falls back to the page's."""
    back = lambda r: F.struct(
        F.coalesce(F.nullif(r["image_id"], F.lit("")), r["page_id"]).alias("image_id"), r["bbox"].alias("bbox"), r["region_type"].alias("type"), best_text(r["ocr_hypotheses"], r["text"]).alias("text"),
        r["confidence"]["score"].alias("score"), *(r[k].alias(k) for k in ("source", "annotation_source", "language", "legibility")),
    )
    return documents.select("image_id", "width", "height", F.transform("regions", back).alias("regions"))
