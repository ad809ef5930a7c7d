"""Open records: JSON lines of any fields as VARIANT, aliases found in them, and every field carried through to the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import edit_profile, error_rate, length_bucket
from pagemill.operators.errors import error_labels
from pagemill.sources.positions import lines_in_order

# Names by which data sets call the same thing, the first found counts.
REGION_LISTS = ("regions", "annotations", "objects", "bboxes")
BOX_NAMES = ("bbox", "box", "bounding_box", "bounds")
TYPE_NAMES = ("type", "label", "class", "category")
TEXT_NAMES = ("text", "transcription", "value")
TYPE_LISTS = ("types", "labels", "classes", "categories")
TEXT_LISTS = ("texts", "transcriptions", "values")

LIST, RECORD = "array<variant>", "map<string,variant>"


def read_records(spark: SparkSession, path: str, limit: int | None = None, index: str = "_row_index") -> DataFrame:
    """JSON lines as they are: index (place in the files), record VARIANT and names, its fields in the order written. Bad and blank lines raise."""
    lines = lines_in_order(spark, path, index, limit)
    return lines.select(index, F.parse_json("value").alias("record"), F.json_object_keys("value").alias("names"))


def field_schema(records: DataFrame, record: str = "record") -> DataFrame:
    """One row: the schema that all records together have, in one pass."""
    return records.agg(F.schema_of_variant_agg(record).alias("schema"))


def is_kind(value: Column, pattern: str) -> Column:
    """Whether a VARIANT's own kind matches; null has none."""
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def is_list(value: Column) -> Column:
    return is_kind(value, "^ARRAY<")


def is_box(value: Column) -> Column:
    """A list of four numbers; strings of digits are none."""
    return is_kind(value, r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$") & (F.size(F.try_variant_get(value, "$", LIST)) == 4)


def truthy(value: Column) -> Column:
    """A VARIANT as text, null where it is null, an empty text, zero or false."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.when(is_kind(value, "^STRING"), text != "").otherwise(~text.isin("0", "0.0", "-0.0", "false")), text)


def _first(of: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(truthy(F.try_variant_get(of, f"$.{n}", "variant")) for n in names))


def normalized_region(item: Column) -> Column:
    """struct<bbox, type, text, raw> of a record that has a box by one of its names, else null."""
    boxes = [F.try_variant_get(item, f"$.{n}", "variant") for n in BOX_NAMES]
    bbox = F.coalesce(*(F.when(is_box(b), F.try_variant_get(b, "$", "array<double>")) for b in boxes))
    region = F.struct(bbox.alias("bbox"), _first(item, TYPE_NAMES).alias("type"), F.coalesce(_first(item, TEXT_NAMES), F.lit("")).alias("text"), item.alias("raw"))
    return F.when(is_kind(item, "^OBJECT<") & bbox.isNotNull(), region)


def regions_in(record: Column, names: Column) -> Column:
    """struct<key, regions>: the regions of an open record and the field they were found in (null: none found).

    A list by one of its usual names comes first, then any list of records in the order of `names`, then a list of boxes whose types
    and texts stand in lists of the same length beside it. Items without a box are no regions; a list without regions does not count.
    """
    record = F.try_variant_get(record, "$", RECORD)

    def listed(key: Column, any_list: bool) -> Column:
        value = F.try_element_at(record, key)
        items = F.try_variant_get(value, "$", LIST)
        usable = is_list(value) if any_list else is_list(value) & is_kind(F.get(items, F.lit(0)), "^OBJECT<")
        regions = F.filter(F.transform(F.when(usable, items), normalized_region), lambda r: r.isNotNull())
        return F.when(F.size(regions) > 0, F.struct(key.alias("key"), regions.alias("regions")))

    def parallel(key: Column) -> Column:
        items = F.try_variant_get(F.try_element_at(record, key), "$", LIST)
        boxes = F.when(is_list(F.try_element_at(record, key)) & (F.size(items) > 0) & F.forall(items, is_box), items)

        def beside(lists: tuple[str, ...], missing: Column) -> Column:
            found = [F.try_variant_get(F.when(is_list(v := F.try_element_at(record, F.lit(n))), v), "$", LIST) for n in lists]
            values = F.coalesce(*(F.when(F.size(x) == F.size(boxes), x) for x in found))
            return F.when(values.isNull(), F.transform(boxes, lambda _: missing)).otherwise(F.transform(values, lambda x: F.try_variant_get(x, "$", "string")))

        three = F.arrays_zip(boxes.alias("b"), beside(TYPE_LISTS, F.lit(None).cast("string")).alias("t"), beside(TEXT_LISTS, F.lit("")).alias("x"))
        regions = F.transform(three, lambda r: F.struct(F.try_variant_get(r["b"], "$", "array<double>").alias("bbox"), r["t"].alias("type"), r["x"].alias("text"), F.lit(None).cast("variant").alias("raw")))
        return F.when(boxes.isNotNull(), F.struct(key.alias("key"), regions.alias("regions")))

    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    usual = first(F.transform(F.array(*map(F.lit, REGION_LISTS)), lambda k: listed(k, True)))
    return F.coalesce(usual, first(F.transform(names, lambda k: listed(k, False))), first(F.transform(names, parallel)))


def enriched_records(records: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Predictions of any further fields: rate, distance, lengths and bucket where a record lacks them; edit counts and labels always anew."""
    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    ref, pred = F.coalesce(get("reference_text"), get("text"), F.lit("")), F.coalesce(get("predicted_text"), F.lit(""))
    rows = records.withColumns({"reference_text": ref, "predicted_text": pred})
    rows = rows.withColumns(
        {
            "cer": F.coalesce(get("cer", "double"), error_rate(F.col("reference_text"), F.col("predicted_text"))),
            "edit_distance": F.coalesce(get("edit_distance", "long"), F.levenshtein("reference_text", "predicted_text").cast("long")),
            "reference_length": F.coalesce(get("reference_length", "long"), F.length("reference_text").cast("long")),
            "prediction_length": F.length("predicted_text").cast("long"),
            "text_length_bucket": F.coalesce(get("text_length_bucket"), length_bucket(F.col("reference_text"))),
            "edits": edit_profile("reference_text", "predicted_text"),
            "tokens_": F.coalesce(get("reference_token_length", "long"), get("token_length", "long")),
        }
    )
    rows = rows.withColumn("error_buckets", error_labels(max_tokens, "tokens_", ref=F.col("reference_text")))
    names = ("insertions", "deletions", "substitutions", "cyrillic_substitutions")
    return rows.withColumns({f"edit_{n}": F.col(f"edits.{n}") for n in names}).drop("edits", "tokens_")


def carried(record: Column, new: dict[str, Column]) -> Column:
    """The record as one JSON object, its own fields as they are, those of `new` in their place, names sorted."""
    old = F.map_filter(F.try_variant_get(record, "$", RECORD), lambda k, _: ~k.isin(*new))
    made = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in new.items())))
    both = F.array_sort(F.map_keys(F.map_concat(old, made)))
    return F.to_json(F.map_from_arrays(both, F.transform(both, lambda k: F.try_element_at(F.map_concat(old, made), k))), {"ignoreNullFields": "false"})


def write_records(df: DataFrame, path: str, record: str = "record", mode: str = "overwrite") -> None:
    """JSON lines of open records; every other column but the names and the place is a field of its own or replaces the record's."""
    new = {c: F.col(f"`{c}`") for c in df.columns if c not in (record, "names", "_row_index")}
    df.select(carried(F.col(record), new).alias("value")).write.mode(mode).text(path)
