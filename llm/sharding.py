"""Sharding of records by weighted rendezvous hashing.

A record's key (its ``doc_id`` as text) draws a number between 0 and 1 for every
shard; the shard whose ``-ln(draw) / weight`` is least takes the record. A shard
gets records in proportion to its weight. As draws of other shards stay as they
are, a new or heavier shard takes records only into itself and a removed or
lighter one only gives its own away. DataFrame functions only.

Slots number the records of a shard from 0 without gaps. A shard may hold any
part of all records, so it is never ordered in one task: records are put in a
seeded order, that order is cut into ranges by its first digits, and a record's
slot is its place in its range plus the records in ranges before.

Defined results: a null text has no bytes (size 1, crc32 0) like an empty one; a
null id has the key ``null``; rows with one id share a shard, whatever their
texts; equal rows get slots of their own, next to each other; a weight of 0
takes nothing; an empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

WEIGHTS = (1.0,) * 8
SEED = "shard"
#: Records of one range of the order, and ranges at least.
RANGE_ROWS = 100_000
LEAST_RANGES = 64
#: Equal records that are written out together.
RUN = 10_000
#: Rows of one written file at most.
FILE_ROWS = 1_000_000


def record_key(column: str | Column = "doc_id") -> Column:
    """A record's stable key: its id as text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("null"))


def claim(key: Column, shard: int, weight: float, seed: str = SEED) -> Column:
    """(cost, shard): what a shard would pay for a record; the least cost wins, then the smaller number."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key)), 1, 13)
    draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def _winner(key: Column, weights: Sequence[float], seed: str) -> Column:
    claims = [claim(key, shard, weight, seed) for shard, weight in enumerate(weights) if weight > 0]
    if not claims:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*claims))


def shard_of(key: Column, weights: Sequence[float] = WEIGHTS, seed: str = SEED) -> Column:
    """Number of the shard that takes a key."""
    return _winner(key, weights, seed)["shard"]


def with_shards(docs: DataFrame, weights: Sequence[float] = WEIGHTS, name: str = "shard", seed: str = SEED) -> DataFrame:
    """The documents with their shard in column ``name``; no shuffle."""
    return docs.withColumn(name, shard_of(record_key(), weights, seed))


def moves(docs: DataFrame, before: Sequence[float], after: Sequence[float], seed: str = SEED) -> DataFrame:
    """(shard, new_shard, records): how many records go where when weights change."""
    pairs = docs.select(shard_of(record_key(), before, seed).alias("shard"), shard_of(record_key(), after, seed).alias("new_shard"))
    return pairs.groupBy("shard", "new_shard").agg(F.count("*").alias("records"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = WEIGHTS, seed: str = SEED, file_rows: int = FILE_ROWS) -> None:
    """Write documents as Parquet below ``path``, one folder ``_shard=<n>`` per shard.

    Each shard is dealt over as many tasks as its rows need, in files of at most
    ``file_rows`` rows.
    """
    parts = F.lit(1 + docs.count() // file_rows)
    part = F.pmod(F.xxhash64(record_key(), common.text_hash()), parts)
    placed = with_shards(docs, weights, "_shard", seed).withColumn("_part", part)
    (
        placed.repartition("_shard", "_part").drop("_part")
        .write.option("maxRecordsPerFile", file_rows).partitionBy("_shard").parquet(path)
    )


def shards(docs: DataFrame, weights: Sequence[float] = WEIGHTS, new_weight: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size (bytes + 1), text_crc32, shard, slot, grown_shard.

    ``grown_shard`` is the shard with one more of ``new_weight``. Two shuffles, both
    of rows without text: equal records are counted, then ranges are ordered.
    """
    data = F.coalesce(common.binary("text"), F.lit(b""))
    records = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
    )
    place = F.md5(F.concat_ws(":", F.lit("slot"), record_key(), F.col("size"), F.col("text_crc32")))
    placed = common.stage(
        records.withColumn("key", place)
        .withColumn("best", _winner(record_key(), weights, seed))
        .withColumn("grown", F.array_min(F.array("best", claim(record_key(), len(weights), new_weight, seed))))
        .select("doc_id", "size", "text_crc32", "n", "key", F.col("best.shard").alias("shard"), F.col("grown.shard").alias("grown_shard")),
        "shards",
    )
    ranges = LEAST_RANGES + placed.count() // RANGE_ROWS
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.shiftright(first * ranges, 32))
    before = (
        placed.groupBy("shard", "range")
        .agg(F.sum("n").alias("records"))
        .withColumn("before", F.sum("records").over(W.partitionBy("shard").orderBy("range")) - F.col("records"))
        .drop("records")
    )
    own = W.partitionBy("shard", "range").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    numbered = placed.withColumn("start", F.sum("n").over(own) - F.col("n")).join(before, ["shard", "range"])
    runs = numbered.withColumn("start", F.col("start") + F.col("before")).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    )
    last = F.least(F.col("run") + RUN, F.col("n")) - 1
    return runs.select(
        "doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("start") + F.col("run"), F.col("start") + last)).alias("slot"), "grown_shard"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards(common.table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _claims(shards: int) -> str:
    return ", ".join(
        f"{{'cost': -ln((('0x' || substr(md5('{SEED}:{shard}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE) "
        f"/ 1.0::DOUBLE, 'shard': {shard}}}"
        for shard in range(shards)
    )


SQL = f"""
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes),
h AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
d AS MATERIALIZED (
  SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: ('0x' || x)::BIGINT)),
           lambda c, b: xor(c >> 8, codes[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM h, t),
s AS (
  SELECT *, list_sort([{_claims(8)}])[1].shard AS shard, list_sort([{_claims(9)}])[1].shard AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || doc_id || ':' || size || ':' || text_crc32),
                          doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INT) AS grown_shard
FROM s
"""
