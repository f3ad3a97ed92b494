"""Exact-match scores of invoice properties against ground truth.

Truth is turned from (file, key, value) rows into one row per file with 17
columns, so that a document meets its truth in one equi-join and all key by key
comparing is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blattwerk.fixed import PROPERTY_KEYS
from blattwerk.functions.text import norm_space
from blattwerk.operators.invoices import property_texts


def truth_by_file(truth: DataFrame) -> DataFrame:
    """One row per file: ``truth`` struct of the known keys, null where a key is not given.

    Files whose only keys are unknown ones keep a row, with all 17 null.
    """
    known = truth.withColumn("value", F.coalesce(norm_space(F.col("value")), F.lit("")))
    wide = known.groupBy("file").agg(
        *[F.expr(f"max(value) FILTER (WHERE key = '{key}') AS `{key}`") for key in PROPERTY_KEYS]
    )
    return wide.select("file", F.struct(*[f"`{key}`" for key in PROPERTY_KEYS]).alias("truth"))


def truth_lookup(items: DataFrame, truth: DataFrame, name: Column, path: Column) -> DataFrame:
    """Adds ``truth``: that of the file name, or else of the path, or else null.

    Truth is aggregated once and meets narrow candidate rows: each distinct (name,
    path) of the items looks up both, the name first, and items get the outcome in
    one join back.
    """
    keyed = items.withColumn("__name", name).withColumn("__path", path)
    asked = keyed.select("__name", "__path").distinct()
    candidates = asked.select(
        "__name", "__path",
        F.posexplode(F.array("__name", "__path")).alias("__order", "file"),
    )
    first = (
        candidates.join(truth_by_file(truth), "file")
        .groupBy("__name", "__path")
        .agg(F.min_by("truth", "__order").alias("truth"))
    )
    own = first.select(F.col("__name").alias("__n"), F.col("__path").alias("__p"), "truth")
    met = F.col("__name").eqNullSafe(F.col("__n")) & F.col("__path").eqNullSafe(F.col("__p"))
    return keyed.join(own, met, "left").drop("__name", "__path", "__n", "__p")


def _scored() -> Column:
    return F.col("truth").isNotNull() & F.col("properties").isNotNull()


def _compared() -> Column:
    """Array of (key, pred, truth, exact_match) for the keys that the truth gives.

    Null without a truth or for a failed reply. There is no filter on the reply
    here: pushed below the parsing, it would parse every reply twice.
    """
    keys = F.array(*[F.lit(key) for key in PROPERTY_KEYS])
    truths = F.expr(f"array({', '.join(f'truth.`{key}`' for key in PROPERTY_KEYS)})")
    zipped = F.arrays_zip(
        keys.alias("key"), property_texts().alias("pred"), truths.alias("truth")
    )
    compared = F.transform(
        F.filter(zipped, lambda pair: pair["truth"].isNotNull()),
        lambda pair: F.struct(
            pair["key"].alias("key"),
            pair["pred"].alias("pred"),
            pair["truth"].alias("truth"),
            ((pair["pred"] != "") & (F.lower(pair["pred"]) == F.lower(pair["truth"]))).alias("exact_match"),
        ),
    )
    return F.when(_scored(), compared)


def match_by_key(items: DataFrame) -> DataFrame:
    """One row per property that the truth of an item gives."""
    others = [name for name in items.columns if name not in ("properties", "truth")]
    return items.select(*others, F.inline(_compared()))


def match_rate(items: DataFrame) -> DataFrame:
    """Adds fields compared, exact matches, their rate, and ``per_key`` (key, pred, truth,
    exact_match); null without a truth or for a failed reply.

    The rate is null as well where the truth names none of the known keys.
    """
    hits = F.size(F.filter("__pairs", lambda pair: pair["exact_match"]))
    known = F.col("__pairs").isNotNull()
    return (
        items.withColumn("__pairs", _compared())
        .withColumn("evaluated_fields", F.when(known, F.size("__pairs")))
        .withColumn("exact_matches", F.when(known, hits))
        .withColumn(
            "exact_match_rate",
            F.round(F.col("exact_matches") / F.nullif(F.col("evaluated_fields"), F.lit(0)), 4),
        )
        .withColumnRenamed("__pairs", "per_key")
    )
