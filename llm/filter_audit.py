"""Audit of filters that act together: what each removes, at every place of every order.

A document is the set of filters that it fails. Applied filters form a state of
the subset lattice; a filter applied to a state is an edge, and an order is a
path from no filter to all of them. What an edge removes depends on its state
alone: documents that fail its filter and none applied before. Forward counts
say how many orders reach a state, backward counts how many leave it, so an edge
lies on ``forward(state) * backward(next state)`` orders; removals weighted that
way and summed over a filter's edges are its removals over all orders (Shapley).
Steps of single orders are read from the same edges.

Documents meet the lattice only as counts per part and set of failures. The one
filter that looks across the table (an earlier equal text) needs a smallest id
per text: rows without text are grouped by hash, counts with them, so no group of
copies is gathered or joined back.

Defined results: a null text is empty (fails A); null ids are never smaller than
another and never fail E; rows equal in id and text do not fail by each other; a
null language is the part ````; an id with several labels counts as good or toxic
if one row says so; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = "[#$%&*|]"
#: Labels are met in so many shares, so that an id with many rows is no single task's.
SHARES = 8
#: Columns that count documents of an outcome.
COUNTS = ("docs", "good", "toxic")


def failures(words: Column, text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    n = F.size(words)
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def as_mask(fails: Sequence[Column]) -> Column:
    """Failures as bits, the first filter lowest."""
    mask = F.lit(0)
    for at, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << at).otherwise(0)
    return mask


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and set of failures: part, mask, docs, good, toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            text.alias("text"),
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        )
        .select(
            "doc_id", "part",
            F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16).alias("hash"),
            as_mask(failures(F.col("words"), F.col("text"))).alias("mask"),
        )
        .groupBy("doc_id", "part", "hash", "mask")
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.pmod(F.xxhash64("hash"), F.lit(SHARES)))
    )
    marked = (
        labels.where("(quality = 1 OR toxic = 1) AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*[F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(mark) for name, mark in (("quality", "good"), ("toxic", "toxic"))])
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    )
    mark = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("good", "toxic")]
    # Never broadcast: Spark judges the shares by their labels' packed files, a small part of what the driver would hold.
    held = rows.join(marked.hint("merge"), ["doc_id", "share"], "left").select("doc_id", "part", "hash", "mask", "n", *mark)
    # Copies of one text by part and labels: how many, and how many of them have the smallest id.
    copies = held.groupBy("hash", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(W.partitionBy("hash"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("unnamed")
    last = 1 << (len(FILTERS) - 1)
    either = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("kept").alias("docs")),
        F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("kept")).alias("docs")),
    )
    counts = copies.withColumn("least", least).withColumn("kept", firsts).select("part", "good", "toxic", F.inline(either))
    return counts.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), *[F.sum(F.col(name) * F.col("docs")).alias(name) for name in ("good", "toxic")]
    )


def orders_through(n: int) -> tuple[list[int], list[int]]:
    """For each state of the lattice of ``n`` filters: orders that reach it, and orders that leave it for the end."""
    states = 1 << n
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for state in range(states):
        for bit in (1 << f for f in range(n) if not state >> f & 1):
            forward[state | bit] += forward[state]
    for state in reversed(range(states)):
        for bit in (1 << f for f in range(n) if not state >> f & 1):
            backward[state] += backward[state | bit]
    return forward, backward


def edges(counts: DataFrame, n: int) -> DataFrame:
    """One row per part and lattice edge, zeros included.

    ``state`` holds the filters before, ``bit`` the edge's filter. Returns part,
    state, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley.
    """
    forward, backward = orders_through(n)
    lattice = F.array(*[
        F.struct(F.lit(state).alias("state"), F.lit(1 << f).alias("bit"), F.lit(forward[state] * backward[state | 1 << f]).cast("long").alias("orders"))
        for state in range(1 << n) for f in range(n) if not state >> f & 1
    ])
    mask = F.col("mask")
    early, fails = mask.bitwiseAND(F.col("state")) != 0, mask.bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, count: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(count)).otherwise(0))

    met = counts.select("part", "mask", *COUNTS, F.inline(lattice))
    sums = met.groupBy("part", "state", "bit", "orders").agg(
        total(~early & ~fails).alias("kept"),
        total(~early & fails).alias("removed"),
        total(early & fails).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(~early & fails, "good").alias("good_lost"),
        total(~early & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum(F.col("orders") * F.col("removed")).over(W.partitionBy("part", "bit"))
    return sums.withColumn("shapley", shapley).drop("orders")


def steps(lattice: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order, read from its edge: part, filter_order, step, and the edge's counts."""
    rows = []
    for order in permutations(filters):
        state = 0
        for step, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            rows.append(("".join(order), step, state, bit))
            state |= bit
    # n! * n rows, whatever the input: 600 for five filters.
    paths = lattice.sparkSession.createDataFrame(rows, "filter_order string, step int, state int, bit int")
    return lattice.join(F.broadcast(paths), ["state", "bit"]).drop("state", "bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return steps(edges(outcomes(docs, labels), len(FILTERS)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = audit(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


_FAIL = "list_contains(fails, substr(filter_order, step, 1))"
_EARLY = "len(list_intersect(fails, string_split(substr(filter_order, 1, step - 1), ''))) > 0"
SQL = rf"""
WITH RECURSIVE p(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || f FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM p WHERE length(filter_order) = 5),
w AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
d AS MATERIALIZED (
  SELECT part, list_filter([
           CASE WHEN len(words) < 200 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
           CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
         coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM w LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad
                    FROM labels GROUP BY doc_id) l USING (doc_id)),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY ALL),
r AS (
  SELECT part, filter_order, step,
         sum(CASE WHEN NOT {_EARLY} AND NOT {_FAIL} THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT {_EARLY} AND {_FAIL} THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN {_EARLY} AND {_FAIL} THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = [substr(filter_order, step, 1)] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT {_EARLY} AND {_FAIL} THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT {_EARLY} AND {_FAIL} THEN bad ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM r
"""
