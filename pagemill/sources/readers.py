"""Scans: page tables, JSON lines manifests, experiments, raw bytes. Missing optional files give nothing, bad lines raise."""

from __future__ import annotations

import json
from collections.abc import Callable
from inspect import Parameter, signature
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.kept import kept
from pagemill.sources.positions import lines_in_order, parquet_in_order

REGION = T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType())), *(T.StructField(n, T.StringType()) for n in ("type", "text", "language", "legibility"))])
PAGE = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in ("file_name", "image_id", "id")), T.StructField("image", T.BinaryType()), T.StructField("image_width", T.IntegerType()), T.StructField("image_height", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "annotation_source")]
    + [T.StructField("year", T.IntegerType()), T.StructField("grade", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("subject", "group", "fund", "content_type")]
    + [T.StructField("_row_index", T.LongType()), T.StructField("regions", T.ArrayType(REGION))]
)
MANIFEST = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in ("crop_id", "split", "crop_path", "image_id")), T.StructField("region_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "region_type", "language", "legibility")]
    + [T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("image_width", T.IntegerType()), T.StructField("image_height", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "annotation_source")]
    + [T.StructField("year", T.IntegerType()), T.StructField("grade", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("subject", "group", "fund", "content_type")]
)
EXPECTED_SPLITS = ("train", "silver", "test", "private")


def read_pages(spark: SparkSession, path: str, split: str | None = None, revision: str | None = None, limit: int | None = None, order: str | None = None, config: str | None = None) -> DataFrame:
    """Pages of one split of a data set laid out as path/[snapshots/revision/][config/]split.

    `_row_index` counts the rows as they stand in the files, files by path, and a limit keeps the first ones; with `order`, a column,
    both go by that instead. An index that a record brings along stays.
    """
    parts = [path.rstrip("/"), *(["snapshots", revision] if revision else []), *(x for x in (config, split) if x)]
    df = spark.read.option("mergeSchema", True).parquet("/".join(parts))
    if not order:
        return parquet_in_order(df, limit=limit)
    return numbered(df if limit is None else df.orderBy(order).limit(limit), order)


def numbered(df: DataFrame, order: str, name: str = "_row_index") -> DataFrame:
    """Adds the place of each row by a key (rows of equal keys in any order, rows without one first), where it has none yet.

    Keys alone are dealt by range, numbered inside each range from where the one before ends, and joined back; no task sees
    all rows, and the other columns, images say, are not sorted.
    """
    keys = df.groupBy(F.col(order).alias("key_")).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, F.col("key_").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    dealt = kept(dealt, "keys")  # ranges are drawn by sample: they are drawn once
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = dealt.groupBy("part").agg(F.sum("n").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy("part").orderBy(F.col("key_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(starts), "part").select("key_", "n", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("at"))
    both = df.join(placed, df[order].eqNullSafe(placed.key_))
    within = F.row_number().over(Window.partitionBy("key_").orderBy("key_")) - 1  # only rows whose key others share
    out = both.where("n = 1").withColumn("place_", F.col("at").cast("long")).unionByName(both.where("n > 1").withColumn("place_", (F.col("at") + within).cast("long")))
    out = out.drop("key_", "n", "at")
    out = out.withColumn(name, F.coalesce(name, "place_") if name in df.columns else F.col("place_"))
    return out.drop("place_")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Sources of differing columns as one; what a source lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = MANIFEST, limit: int | None = None, order: str | None = None, index: str | None = None) -> DataFrame:
    """JSON lines; a blank or broken line raises when it is read. A limit takes the first lines of the files, or the first rows by `order`.

    index: a column for the place of a row in its files.
    """
    place = index or "_line"
    schema = schema or spark.read.json(path).schema
    numbered_lines = index is not None or limit is not None and not order
    lines = lines_in_order(spark, path, place, None if order else limit) if numbered_lines else spark.read.text(path)
    blank = F.raise_error(F.concat(F.lit(f"a blank line in {path}"), *([F.lit(" after line "), F.col(place).cast("string")] if numbered_lines else [])))
    record = F.when(F.trim("value") == "", blank.cast(schema)).otherwise(F.from_json("value", schema, {"mode": "FAILFAST"}))
    rows = lines.select(record.alias("r"), *([place] if numbered_lines else [])).select("r.*", *([index] if index else []))
    return rows.orderBy(order).limit(limit) if order and limit is not None else rows


def configured(spark: SparkSession, path: str, plan: Callable) -> dict:
    """The parameters that a JSON file holds for a plan; a name that the plan does not take, or a kind that differs from its default's, raises."""
    given, known = read_document(spark, path), signature(plan).parameters
    for name, value in given.items():
        default = known[name].default if name in known else None
        if name not in known or default not in (None, Parameter.empty) and not isinstance(value, (type(default), int) if isinstance(default, float) else type(default)):
            raise ValueError(f"{path}: {name}={value!r} is no parameter of {plan.__name__}")
    return given


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document, {} where the file is missing; read by Spark, so any store will do."""
    if not exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_experiment(spark: SparkSession, folder: str, max_target_length: int | None = None) -> dict:
    """An experiment's metrics, metadata, config and environment as dicts and its enriched predictions as a frame or None."""
    from pagemill.operators.errors import enrich

    out = {k: read_document(spark, f"{folder}/{k}.json") for k in ("metrics", "metadata", "config", "environment")}
    if max_target_length is None:
        max_target_length = ((out["metrics"].get("target_length_policy") or {}).get("val") or {}).get("max_target_length")
    path = f"{folder}/predictions.jsonl"
    out["predictions"] = enrich(spark.read.option("mode", "FAILFAST").json(path), max_target_length) if exists(spark, path) else None
    return out


@F.pandas_udf(T.StructType([T.StructField("error_start", T.IntegerType()), T.StructField("error_end", T.IntegerType()), T.StructField("error_hex", T.StringType())]))
def utf8_error(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            bytes(data or b"").decode()
            rows.append((None, None, None))
        except UnicodeDecodeError as e:
            rows.append((e.start, e.end, bytes(data[e.start : e.end]).hex()))
    return pd.DataFrame(rows, columns=["error_start", "error_end", "error_hex"]).astype({"error_start": "Int32", "error_end": "Int32"})


def utf8_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, strict validity, place of the first error and replacement characters after a lossy decode, for each file."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return spark.read.format("binaryFile").load(path).select(
        "path",
        F.col("length").alias("n_bytes"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("valid"),
        utf8_error("content").alias("error"),
        F.regexp_count(text, F.lit("\ufffd")).alias("n_replacement"),
        F.length(text).alias("n_chars"),
    )


def file_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def image_id(position: Column) -> Column:
    """The first of file_name, image_id and id that is not empty, else a name by position; raises where that is null too."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("file_name", "image_id", "id")]
    numbered_name = F.when(position.isNotNull(), F.format_string("stream_%06d.jpg", position)).otherwise(F.raise_error(F.lit("a page without an id and without a position")))
    return F.coalesce(*(F.when(n != "0", n) for n in named), numbered_name)


def revision_of(path: Column) -> Column:
    """The part after `snapshots` in a path, or null."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "snapshots")
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def first_revision(pages: DataFrame, path: str = "path", position: str = "_row_index") -> DataFrame:
    """The revision in the first path, by position, that names one; null where none does. One row, combined before the shuffle."""
    found = revision_of(F.col(path))
    return pages.agg(F.min_by(found, F.when(found.isNotNull(), F.col(position))).alias("dataset_revision"))


def discover_splits(spark: SparkSession, path: str) -> DataFrame:
    """(config, split, n_files, n_bytes) of a data set's folders of Parquet: path/[config/]split/*.parquet; config is `default` where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    parts = F.split(F.substring_index(F.col("path"), base + "/", -1), "/")
    depth = F.size(parts)
    split = F.when(depth >= 2, F.get(parts, depth - 2)).otherwise(F.regexp_extract(F.get(parts, F.lit(0)), r"^([A-Za-z]+)", 1))
    config = F.when(depth >= 3, F.get(parts, depth - 3)).otherwise(F.lit("default"))
    return files.groupBy(config.alias("config"), split.alias("split")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def probed_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """For each wanted role the first column that the frame has, names compared without case; nothing is read."""
    have = {c.lower(): c for c in df.columns}
    return {role: next((have[n.lower()] for n in names if n.lower() in have), None) for role, names in wanted.items()}


def crop_path(manifest: str, column: Column) -> Column:
    """Manifests lie one folder below the root their paths start from."""
    return F.concat_ws("/", F.lit(str(PurePosixPath(manifest).parent.parent)), column)


def flat_regions(pages: DataFrame) -> DataFrame:
    """One row for each region with its position; pages without regions keep one row with nulls."""
    return pages.select("*", F.posexplode_outer("regions").alias("region_index", "region")).drop("regions")


def zipped_regions(boxes: Column, types: Column, texts: Column) -> Column:
    """Parallel arrays as one array of regions, by position."""
    return F.transform(F.arrays_zip(boxes.alias("b"), types.alias("t"), texts.alias("x")), lambda r: F.struct(r["0"].alias("bbox"), r["1"].alias("type"), r["2"].alias("text")))
