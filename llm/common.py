"""What the operators share: reading, shared tables, words, seeded order."""

from __future__ import annotations

import gc
import sys
import time
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blattwerk.session import new_table_path

#: ASCII letters to lower case; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that ``bytes.split()`` cuts at: blank and \\x09 to \\x0D.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows whose texts go to a Python worker together.
BATCH_ROWS = 2000
#: Keys of 16 bytes that are broadcast at most: 8 MB, tens of MB as a hash table.
BROADCAST_KEYS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read. ``free`` gives the
    shuffle files of the steps before back at once, where they are large.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_table_path(spark, name)
    df.write.parquet(path)
    if free:
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the JVM collects them.

    A second collection takes what the first has only marked.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def held(name: str, key: object, make: Callable[[], object]) -> object:
    """A worker's ``name`` for ``key``, made when it is first asked for; the one before is given up.

    Kept in a module of its own: what travels to a worker by value has no globals
    that outlive a task.
    """
    place = sys.modules.setdefault("llm_held", types.ModuleType("llm_held")).__dict__
    if place.get(name, (None, None))[0] != key:
        place.pop(name, None)
        place[name] = (key, make())
    return place[name][1]


def text_hash(text: str | Column = "text") -> Column:
    """Hash of a text, null as empty; with the id it names a row of ``documents``."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def rows_by_key(docs: DataFrame) -> DataFrame:
    """(id, hash, row): each document whole in ``row``, so that no column of it can clash."""
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"), whole.alias("row"))


def same_key(left: str, right: str) -> Column:
    """Whether two aliased frames' ``id`` (null equals null) and ``hash`` agree."""
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.hash") == F.col(f"{right}.hash"))


def keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents that are not among ``rejected`` (doc_id, text_hash).

    Rejected keys are written and counted first. Up to ``BROADCAST_KEYS`` they are
    sent to the documents; beyond, both sides are shuffled.
    """
    gone = stage(keys(rejected), "rejected")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return rows_by_key(docs).alias("d").join(gone.alias("g"), same_key("d", "g"), "left_anti").select("row.*")


def binary(column: str | Column) -> Column:
    """UTF-8 bytes of a text column."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def batches(rows: Iterator[pa.RecordBatch], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred (finaliser of splitmix64); one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    MOST = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            steps = 1 << size.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                column = np.full(steps, base, np.uint64)
                column[0] = 1
                setattr(self, name, np.multiply.accumulate(column))
        return self.up[:size], self.down[:size]


POWERS = _Powers()


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive values, by differences of one running sum."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = POWERS.of(len(hashes))
    sums = np.cumsum(hashes * up)
    runs = sums[width - 1 :].copy()
    runs[1:] -= sums[: n - 1]
    runs *= down[:n]
    return mix(runs + np.uint64(width))


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32 of the document's id as text leaves ``rest``; a null id counts as 'null'."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.crc32(key.cast("binary")) % modulus == rest


def seeded(seed: str) -> Column:
    """32 hexadecimal digits by which documents are put in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def at_most(rows: DataFrame, most: int, key: str, *ties: str) -> DataFrame:
    """The first ``most`` rows by a seeded ``key`` (hexadecimal digits).

    Rows are counted, and only keys in the range that holds half as many again go
    on, so a task hands over its share of the sample and not ``most`` rows.
    """
    total = rows.count()
    if total > 2 * most:
        first = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
        rows = rows.where(first < int(1.5 * most / total * 2**32) + 1)
    return rows.orderBy(key, *ties).limit(most)
