"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


#: Rows that one task of a round writes, once all cores have some.
ROWS_PER_TASK = 20_000


def few(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` in the tasks that ``count`` rows are worth, so that a small table is not hundreds of files."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, count // ROWS_PER_TASK))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    ``links`` has two columns of one orderable type. Each round only takes
    minima per node and joins them back to the links, so a node with very many
    links is summed in parts and never listed; links are rewritten to point
    nearer to the smallest node until nothing changes (the logarithm of the
    longest chain, about). Every round is written to the shared folder, in files
    by the number of links; ``links`` is counted first, so it should be a staged table.
    """
    x, y = links.columns
    now = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
    now = common.stage(few(now, links.count()), "links")
    state = _state(now)
    while state[0]:
        # Large star: larger neighbours of u move to the least node around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        rows = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = common.stage(few(rows, state[0]), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return few(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), state[0])
