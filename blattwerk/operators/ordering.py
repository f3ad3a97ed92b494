"""Running totals and numbers over a whole ordered table.

A plain window without partitions would send every row through one task. Here
the (narrow) rows are range-partitioned and written once; the total of each
range is a small table with at most one row per shuffle partition, whose
running sum is added to the running sum inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blattwerk.session import stage


def running_total(
    rows: DataFrame, value: Column, order: Column, name: str, by: str | None = None
) -> DataFrame:
    """Adds ``name``: sum of ``value`` over all rows up to this one.

    ``order`` has to be distinct; with ``by`` (few different values) the sum
    starts again for each of its values. ``rows`` should be narrow.
    """
    keys = [F.col(by)] if by else []
    ranged = stage(
        rows.withColumn("__order", order)
        .withColumn("__value", value)
        .repartitionByRange(*keys, F.col("__order"))
        .withColumn("__range", F.spark_partition_id()),
        "ranges",
    )
    same = ([by] if by else []) + ["__range"]
    totals = ranged.groupBy(*same).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *same, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*same).orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    # At most (values of ``by``) x (shuffle partitions) offsets: always small.
    return (
        ranged.join(F.broadcast(offsets), same)
        .withColumn(name, F.col("__before") + F.sum("__value").over(inside))
        .drop("__order", "__value", "__range", "__before")
    )


def number_rows(rows: DataFrame, order: Column, name: str, by: str | None = None) -> DataFrame:
    """Adds ``name``: place of the row in ``order``, from 1, without gaps."""
    return running_total(rows, F.lit(1).cast("bigint"), order, name, by)
