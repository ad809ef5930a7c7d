"""Writers: JSON lines with sorted names, CSV, submissions, reports, checksummed archives."""

from __future__ import annotations

import difflib
import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import one_line

#: Regions whose text is never submitted.
NO_TEXT = ("image", "graph")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, names sorted, nulls written."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_manifest_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, boxes as JSON, line ends in texts as backslash n, quotes doubled."""
    cols = [F.to_json(c).alias(c) if kind.startswith(("array", "struct")) else one_line(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in sorted(df.dtypes)]
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Manifest rows in order of image and region, one folder a split; a split is cut by range, so its files are in order too."""
    df.repartitionByRange("split", "image_id", "region_index").sortWithinPartitions("split", "image_id", "region_index").write.mode(mode).partitionBy("split").option("ignoreNullFields", False).json(path)


def valid_pages(df: DataFrame, image: str = "image") -> DataFrame:
    """Raises, when read, on a page without id or a region without type or positive area."""
    bad = F.col("region_type").isNull() | (F.col("region_type") == "") | (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    where = F.concat(F.lit("invalid region or id on page "), F.coalesce(F.col(image).cast("string"), F.lit("None")))
    return df.withColumn(image, F.when(F.col(image).isNull() | (F.col(image) == "") | bad, F.raise_error(where)).otherwise(F.col(image)))


def submission_frame(ordered: DataFrame, image: Column) -> DataFrame:
    """(image, regions): regions in reading order as compact JSON of bbox, type and text."""
    text = F.when(F.col("region_type").isin(*NO_TEXT), "").otherwise(F.coalesce("text", F.lit("")))
    region = F.struct(F.array(*(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), F.col("region_type").alias("type"), text.alias("text"))
    pairs = F.array_sort(F.collect_list(F.struct("reading_index", region.alias("r"))))
    return ordered.groupBy(image.alias("image")).agg(F.to_json(F.transform(pairs, lambda p: p.r)).alias("regions"))


def write_submission(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.orderBy("image").write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_failures(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one failure each, for any number of them; write_failure_array makes one array."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_failure_array(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One JSON array of at most so many failures in a file of the driver; more raise. Gives their number."""
    rows = [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).toPandas().iloc[:, 0]]
    if len(rows) > most:
        raise ValueError(f"more than {most} failures; write them as lines")
    write_json(rows, path)
    return len(rows)


def write_prediction_artifacts(df: DataFrame, path: str, sample: int = 20) -> None:
    """All rows, problem rows and a sample in order of id, from one read."""
    df = df.persist()
    try:
        problem = F.expr("coalesce(contains(predicted_text, decode(X'EFBFBD', 'UTF-8')), false) OR coalesce(trim(predicted_text), '') = '' OR array_contains(error_buckets, 'repeated_token_degeneration')")
        write_jsonl(df, f"{path}/predictions")
        write_jsonl(df.where(problem), f"{path}/problem_predictions")
        write_jsonl(df.orderBy("crop_id").limit(sample), f"{path}/sample_predictions")
    finally:
        df.unpersist()


def write_error_analysis(df: DataFrame, path: str, k: int = 50) -> None:
    """hardest, longest_failures, repeated, truncation and representative rows, each a top-k of one persisted frame."""
    df = df.persist()
    try:
        kept = {
            "hardest": df.orderBy(F.desc("cer"), F.desc("reference_length"), "crop_id"),
            "longest_failures": df.where("cer > 0").orderBy(F.desc("reference_length"), F.desc("cer"), "crop_id"),
            "repeated": df.where(F.array_contains("error_buckets", "repeated_token_degeneration")).orderBy("crop_id"),
            "truncation": df.where(F.array_contains("error_buckets", "truncation_failure")).orderBy("crop_id"),
            "representative": df.orderBy(F.coalesce(F.col("source").cast("string"), F.lit("None")), "crop_id"),
        }
        for name, rows in kept.items():
            write_jsonl(rows.limit(k), f"{path}/{name}")
    finally:
        df.unpersist()


def rekeyed(df: DataFrame, split: str, manifest: str | None = None) -> DataFrame:
    """Rows for a copied crop folder: paths become crops/split/name, ordered by crop_id."""
    out = df.withColumns({"crop_path": F.concat(F.lit(f"crops/{split}/"), F.substring_index("crop_path", "/", -1)), "selected_split": F.lit(split)})
    return (out.withColumn("source_manifest", F.lit(manifest)) if manifest else out).orderBy("crop_id")


def text_diff(reference: str, predicted: str) -> str:
    return "\n".join(difflib.unified_diff(reference.splitlines(), predicted.splitlines(), "reference", "predicted", lineterm=""))


def hardest_pages_markdown(pages: DataFrame, k: int = 5) -> str:
    """A report on the k pages of highest rate; only these come to the driver."""
    out = ["# Hardest pages", ""]
    for r in pages.orderBy(F.desc("page_cer"), "image_id").limit(k).collect():
        out += [f"## {r['image_id']}", "", f"- rate: {r['page_cer']:.6f}", f"- edits: {r['edit_distance']} of {r['reference_length']}", "", "```diff", text_diff(r["reference_text"] or "", r["predicted_text"] or ""), "```", ""]
    return "\n".join(out)


def write_json(value: dict | list, path: str) -> None:
    """A small result on the driver: sorted names, indented."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8")


def zip_folder(folder: str, archive: str) -> None:
    """Members in sorted order, under the folder's name, with a fixed date, so equal folders give equal archives."""
    root = Path(folder)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for p in sorted(x for x in root.rglob("*") if x.is_file()):
            z.writestr(zipfile.ZipInfo(p.relative_to(root.parent).as_posix(), (1980, 1, 1, 0, 0, 0)), p.read_bytes(), zipfile.ZIP_DEFLATED, 6)
