"""Invoice properties: replies to typed fields, fill ratio, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk.fixed import LIST_KEYS, PROPERTY_KEYS
from blattwerk.functions import replies
from blattwerk.functions.text import normalize_value, strip


def property_values(separator: str, name: str = "properties") -> Column:
    """Array of the 17 values in column ``name``, in key order, lists joined."""
    values = [
        f"array_join({name}.`{key}`, '{separator}')" if key in LIST_KEYS else f"{name}.`{key}`"
        for key in PROPERTY_KEYS
    ]
    return F.expr(f"array({', '.join(values)})")


def property_texts() -> Column:
    """Comparable texts of the 17 ``properties``; lists, as coerced, as ``a | b``."""
    return F.transform(property_values(" | "), lambda value: normalize_value(value))


def parse_replies(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``properties`` (null on error) and ``error`` to model replies.

    A blank reply means that nothing was asked: all properties are empty.
    """
    return (
        rows.withColumn("__stripped", strip(F.col(reply)))
        .withColumn("__text", replies.json_text(F.col("__stripped")))
        .withColumn("__json", replies.parse_json_block(F.col("__text")))
        .withColumn("__fields", replies.reply_fields(F.col("__json")))
        .withColumn("error", replies.reply_error(F.col("__json"), F.col("__fields")))
        .withColumn(
            "__values",
            F.when(F.col("__fields").isNotNull(), replies.coerce_properties(F.col("__fields"))),
        )
        .withColumn(
            "properties",
            F.when(F.col("__values").isNotNull(), replies.property_struct("__values")),
        )
        .drop("__stripped", "__text", "__json", "__fields", "__values")
    )


def invoice_fill(rows: DataFrame) -> DataFrame:
    """Adds how many of the 17 properties are filled, and their share.

    Works on the columns of one row: no shuffle, and no stripping, as parsed
    values are normalised and lists hold no blank texts. Both are null for a
    reply that gave no properties, so that means leave it out.
    """
    tests = [
        f"int(size(properties.`{key}`) > 0)" if key in LIST_KEYS else f"int(properties.`{key}` <> '')"
        for key in PROPERTY_KEYS
    ]
    filled = F.when(F.col("properties").isNotNull(), F.expr(" + ".join(tests)))
    return rows.withColumn("filled_properties", filled).withColumn(
        "filled_ratio", F.round(F.col("filled_properties") / F.lit(len(PROPERTY_KEYS)), 4)
    )


def property_rows(rows: DataFrame) -> DataFrame:
    """Long form: one row per property, with its comparable text."""
    keys = F.array(*[F.lit(key) for key in PROPERTY_KEYS])
    others = [name for name in rows.columns if name != "properties"]
    pairs = F.arrays_zip(keys.alias("key"), property_texts().alias("value"))
    return rows.select(*others, F.inline(pairs))


def _mean_ratio() -> Column:
    """Mean of the rounded ratios; summed in ten-thousandths, so that the
    result does not depend on the order of the rows."""
    parts = F.sum(F.round(F.col("filled_ratio") * 10000).cast("bigint"))
    return F.coalesce(
        F.round(parts / F.nullif(F.count("filled_ratio"), F.lit(0)) / 10000, 4), F.lit(0.0)
    )


def invoice_run_summary(items: DataFrame) -> DataFrame:
    """One row: number of files and mean fill ratio (0 without files)."""
    return items.agg(
        F.count("*").alias("total_files"), _mean_ratio().alias("avg_property_fill_ratio")
    )


def invoice_method_summary(items: DataFrame) -> DataFrame:
    """Items, seconds and mean fill ratio per method."""
    return items.groupBy("method").agg(
        F.count("*").alias("total_items"),
        F.round(F.sum("seconds"), 3).alias("total_time_seconds"),
        F.round(F.sum("seconds") / F.count("*"), 3).alias("avg_time_seconds"),
        _mean_ratio().alias("avg_property_fill_ratio"),
    )
