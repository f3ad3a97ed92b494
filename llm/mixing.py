"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources at once; its membership pattern is that
set. Documents are aggregated by pattern, so the flow network holds patterns and
sources, never documents:

    supply -> pattern   first use of its words free, each repetition dearer
    pattern -> source   for each member source
    source -> demand    up to its target

As repetition costs are convex and lie on the supply arcs alone, the cheapest
flow is found level by level: all free capacity is routed first (paths may still
move earlier words to another source), then the next repetition. Documents are
taken whole, in a seeded order: the first ones of a pattern up to the routed
words, and one closing document that comes nearest to what is left.

Defined results: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in order; documents without any source take nothing;
equal rows are separate documents; an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
USES = 2
SEED = "mix"
#: Seeded order is cut into this many ranges of its first three digits, so that
#: running sums of a hot source are made range by range.
RANGE_DIGITS = 3
#: Tables of one row per pattern are broadcast up to so many patterns, joined beyond.
BROADCAST_PATTERNS = 100_000


_NOWHERE = object()


def n_words(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weigh(sources: Sequence[str | None], weights: Sequence[int] = WEIGHTS) -> dict[str | None, int]:
    """Weights, repeating, over sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[at % len(weights)] for at, s in enumerate(order)}


def targets(sizes: dict, weights: dict, total: float, uses: int = USES) -> dict:
    """Shares of ``total`` by weight; what exceeds ``uses`` times a source is reshared."""
    full: set = set()
    while True:
        rest = sum(weights[s] for s in sizes if s not in full)
        each = (total - uses * sum(sizes[s] for s in full)) / rest if rest else 0.0
        above = {s for s in sizes if s not in full and weights[s] * each > uses * sizes[s]}
        if not above:
            return {s: float(uses * sizes[s]) if s in full else weights[s] * each for s in sizes}
        full |= above


def route(patterns: dict[tuple, int], quotas: dict, uses: int = USES) -> dict[tuple[tuple, object], int]:
    """Words of each pattern that go to each of its sources, at least repetition.

    Level by level, shortest augmenting paths from patterns with capacity left
    at this level to sources with quota left.
    """
    flow: dict[tuple[tuple, object], int] = {(p, s): 0 for p in patterns for s in p}
    members: dict[object, list[tuple]] = {s: [] for s in quotas}
    for p in patterns:
        for s in p:
            members[s].append(p)
    need = {s: int(q) for s, q in quotas.items()}
    for _ in range(uses):
        left = dict(patterns)
        for start in patterns:
            while left[start] > 0:
                came: dict = {("p", start): None}
                queue, end = deque([("p", start)]), _NOWHERE
                while queue and end is _NOWHERE:
                    kind, node = queue.popleft()
                    if kind == "p":
                        for s in node:
                            if ("s", s) not in came:
                                came["s", s] = ("p", node)
                                if need[s] > 0:
                                    end = s
                                    break
                                queue.append(("s", s))
                    else:
                        for p in members[node]:
                            if flow[p, node] > 0 and ("p", p) not in came:
                                came["p", p] = ("s", node)
                                queue.append(("p", p))
                if end is _NOWHERE:
                    break
                path, at = [], ("s", end)
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()
                steps = list(zip(path, path[1:], strict=False))
                back = [flow[b[1], a[1]] for a, b in steps if a[0] == "s"]
                words = min([left[start], need[end], *back])
                for a, b in steps:
                    if a[0] == "p":
                        flow[a[1], b[1]] += words
                    else:
                        flow[b[1], a[1]] -= words
                left[start] -= words
                need[end] -= words
    return flow


def mix(
    docs: DataFrame,
    members: str = "members",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    uses: int = USES,
    seed: str = SEED,
) -> DataFrame:
    """Documents with size, pattern, and how often (0 to ``uses``) the mix takes each.

    ``docs`` has ``doc_id``, ``text`` and the array column ``members``. Only
    pattern totals reach the driver: one row per distinct pattern. The order of a
    pattern's documents is summed range by range, so no task holds a whole source.
    Returns doc_id, members, text_hash, size, routes (per member source:
    its size, its target, and the words of this pattern routed to it), times.
    """
    sized = common.stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>")))).alias("members"),
            n_words("text").alias("size"),
            common.seeded(seed).alias("key"),
            common.text_hash().alias("text_hash"),
        ),
        "mix-sizes",
    )
    patterns = {tuple(r.members): r.size for r in sized.groupBy("members").agg(F.sum("size").alias("size")).collect()}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    goal = targets(sizes, weigh(list(sizes), weights), share * sum(patterns.values()), uses)
    flow = route(patterns, goal, uses)
    used = {p: sum(flow[p, s] for s in p) for p in patterns}
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [
            (list(p), used[p] // size if size else 0, used[p] % size if size else 0,
             [(s, sizes[s], goal[s], flow[p, s]) for s in p])
            for p, size in patterns.items()
        ],
        "members array<string>, all_times long, rest long, "
        "routes array<struct<source:string,source_size:long,target:double,words:long>>",
    )
    small = F.broadcast if len(patterns) <= BROADCAST_PATTERNS else (lambda rows: rows)
    span = F.substring("key", 1, RANGE_DIGITS)
    ranges = (
        sized.groupBy("members", span.alias("span"))
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(W.partitionBy("members").orderBy("span")) - F.col("words"))
        .drop("words")
    )
    own = W.partitionBy("members", "span").orderBy("key", "size", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    ordered = common.stage(
        sized.withColumn("span", span)
        .join(ranges, ["members", "span"])
        .withColumn("upto", F.sum("size").over(own) + F.col("before"))
        .join(small(plan.drop("routes")), "members")
        .withColumn("first", F.col("upto") <= F.col("rest")),
        "mix-order",
    )
    # The closing document of each pattern: one row per pattern.
    gap = F.col("rest") - F.col("taken")
    taken = ordered.groupBy("members").agg(
        F.max("rest").alias("rest"), F.coalesce(F.sum(F.when(F.col("first"), F.col("size"))), F.lit(0)).alias("taken")
    )
    closing = (
        ordered.where(~F.col("first") & (F.col("size") > 0))
        .select("members", "size", "key", "text_hash", "upto")
        .join(small(taken.where(gap > 0)), "members")
        .where(F.abs(gap - F.col("size")) < gap)
        .groupBy("members")
        .agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "key", "size", "text_hash", "upto")).alias("closing"))
    )
    is_closing = (F.col("closing.key") == F.col("key")) & (F.col("closing.upto") == F.col("upto"))
    more = F.when(F.col("first") | F.coalesce(~F.col("first") & is_closing, F.lit(False)), 1).otherwise(0)
    # Empty documents ahead are first even where nothing is left over.
    times = F.least(F.col("all_times") + more, F.lit(uses))
    return (
        ordered.join(small(closing), "members", "left")
        .join(small(plan.select("members", "routes")), "members")
        .select("doc_id", "text_hash", "members", "size", "routes", times.alias("times"))
    )


def by_source(docs: DataFrame) -> DataFrame:
    """Documents whose only membership is their source, null included."""
    return docs.select("doc_id", "text", F.array(F.col("source").cast("string")).alias("members"))


_WORDS = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, {_WORDS} AS size, md5('{SEED}:' || doc_id) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER r AS k, 2 * source_size / w AS ratio,
         coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY 2 * source_size / w DESC, source DESC NULLS FIRST) AS w_rest
  FROM s WINDOW r AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM s),
cut AS (
  SELECT k, (total - full_before::DOUBLE) / w_rest::DOUBLE AS each_w FROM o, t
  WHERE w * ((total - full_before::DOUBLE) / w_rest::DOUBLE) <= 2 * source_size ORDER BY k LIMIT 1),
g AS (
  SELECT o.source, source_size,
         CASE WHEN o.k < cut.k THEN (2 * source_size)::DOUBLE ELSE w * each_w END AS target FROM o, cut),
u AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS all_times,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS rest FROM g),
c AS (
  SELECT d.*, u.source_size, u.target, u.all_times, u.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
f AS (
  SELECT *, upto <= rest AS first,
         rest - coalesce(sum(size) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM c),
z AS (
  SELECT *, CASE WHEN NOT first AND size > 0 AND abs(gap - size) < gap THEN
           row_number() OVER (PARTITION BY source, NOT first AND size > 0 AND abs(gap - size) < gap
                              ORDER BY abs(gap - size), key) END AS nearest FROM f)
SELECT doc_id, size, source_size, target,
       CAST(size * (all_times + CASE WHEN first OR coalesce(nearest, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM z
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(by_source(common.table(spark, folder, "documents")))
    own = F.col("routes")[0]
    return mixed.select(
        "doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"),
        (F.col("size") * F.col("times")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, once per ``copy`` (1 to ``USES``; replaces a column of that name).

    Rows equal in id and text share their copies out among them.
    """
    times = mix(by_source(docs)).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.sum("times").alias("times"), F.count("*").alias("rows")
    )
    taken = common.stage(times.where("times > 0"), "mix-times")
    met = common.rows_by_key(docs).alias("d").join(taken.alias("t"), common.same_key("d", "t"))
    place = F.row_number().over(W.partitionBy("t.id", "t.hash").orderBy("t.hash"))
    rest = F.when(place <= F.col("times") % F.col("rows"), 1).otherwise(0)
    copies = (F.floor(F.col("times") / F.col("rows")) + rest).cast("int")
    names = [F.col(f"row.`{name}`") for name in docs.columns if name != "copy"]
    return (
        met.select("row", copies.alias("copies")).where("copies > 0")
        .select(*names, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    )
