"""Page records and ground truth from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blattwerk import schemas
from blattwerk.functions.replies import scalar_text
from blattwerk.functions.text import norm_space, normalize_value
from blattwerk.sources import json_objects


def pages_from_records(records: DataFrame) -> DataFrame:
    """Page table from record columns; absent fields become empty.

    A ``document`` column is kept where the records have one.
    """
    nothing = F.array().cast("array<string>")
    document = F.col("document") if "document" in records.columns else F.lit("")
    return records.select(
        F.coalesce("_meta.method", F.lit("")).alias("method"),
        document.alias("document"),
        F.col("slide_number").alias("page"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("tables", F.array().cast(f"array<{schemas.TABLE}>")).alias("tables"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("images_ocr", nothing).alias("images_ocr"),
        F.coalesce("vector_ready_text", F.lit("")).alias("vector_ready_text"),
        F.coalesce("_meta.time_seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("_meta.token_count", F.lit(0)).alias("tokens"),
    )


def read_extractions(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Page records of an earlier run: JSON lines, or files that hold one array each."""
    schema = f"document string, {schemas.PAGE_JSON}"
    return pages_from_records(
        spark.read.schema(schema).option("multiLine", str(one_array).lower()).json(path)
    )


def truth_values(rows: DataFrame) -> DataFrame:
    """``(file, key, value)`` from ``file`` and a map ``fields`` of its JSON values."""
    rows = rows.select("file", F.explode("fields").alias("key", "field"))
    items = F.transform(
        F.try_variant_get("field", "$", "array<variant>"),
        lambda item: F.coalesce(norm_space(scalar_text(item)), F.lit("None")),
    )
    listed = F.array_join(F.filter(items, lambda text: text != ""), " | ")
    return rows.select(
        "file",
        "key",
        F.when(F.schema_of_variant("field").startswith("ARRAY"), listed)
        .otherwise(normalize_value(scalar_text(F.col("field"))))
        .alias("value"),
    )


def truth_from_json(texts: DataFrame) -> DataFrame:
    """Ground truth as ``(file, key, value)`` from a ``value`` column of JSON objects.

    A list becomes ``a | b``; a null is the empty text. A file whose object is
    empty, or that has no object, gives no row.
    """
    files = texts.select(F.explode(_files("value")).alias("file", "fields"))
    return truth_values(files.select("file", _fields("fields").alias("fields")))


def _files(text: str) -> Column:
    return F.from_json(text, "map<string,variant>")


def _fields(value: str) -> Column:
    """Fields of a JSON object; null where the value is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of JSON files ``{file name or path: {key: value}}``, of any length.

    A file may hold one object, over any lines, or one object per line; large ones are
    read by many tasks. Of a name that a file repeats the last object counts.
    """
    members = json_objects.read_members(spark, path)
    files = members.select("path", "start", "place", F.posexplode(F.map_entries(_files("text"))).alias("at", "entry"))
    last = files.groupBy("path", F.col("entry.key").alias("file")).agg(
        F.max_by(F.col("entry.value"), F.struct("start", "place", "at")).alias("value")
    )
    return truth_values(last.select("file", _fields("value").alias("fields")))
