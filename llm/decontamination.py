"""Benchmark decontamination by one Aho-Corasick automaton.

Items and documents are normalised alike: ASCII letters to lower case, every
other ASCII character but digits to a blank. An item gives its windows of
``WINDOW`` consecutive words; an item of fewer words is one window. Documents
are scanned once; hits are carried back to code points of the original text.

Defined results: null or wordless texts have no words and no hits; a null item
id hits but is not listed; of items with one id the windows are joined; repeated
documents each get their row; an empty benchmark hits nothing. Other columns of
both tables are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

WINDOW = 10
#: Bytes of window texts that one automaton holds, which takes some twenty times that
#: in each worker; a larger benchmark is cut into blocks by a hash of the window, and
#: documents are scanned once per block.
AUTOMATON_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BLANK = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_BLANK).split() if text else []


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows (as bytes) with the ids of their items and a block number's hash."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, found = [], []
            for item, text in zip(common.blobs(batch, "item_id"), common.blobs(batch, "text"), strict=True):
                own = words(text)
                for at in range(max(1, len(own) - WINDOW + 1) if own else 0):
                    ids.append(item)
                    found.append(b" ".join(own[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "window"]
            )

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.binary("text").alias("text"))
    return rows.mapInArrow(cut, "item_id string, window binary").groupBy("window").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )


def _automaton(windows: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for window, items in windows:
        text = f" {window.decode('latin-1')} "
        machine.add_word(text, (text.count(" ") - 1, items))
    machine.make_automaton()
    return machine


class _Block:
    """Windows of one automaton, broadcast; a worker makes the automaton once."""

    def __init__(self, spark: SparkSession, rows: list) -> None:
        self.shared = spark.sparkContext.broadcast([(bytes(r.window), list(r.items)) for r in rows])
        self.key = uuid.uuid4().hex

    def automaton(self) -> ahocorasick.Automaton:
        return common.held("automaton", self.key, lambda: _automaton(self.shared.value))


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(docs: DataFrame, block: _Block) -> DataFrame:
    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = block.automaton()
        for batch in common.batches(rows):
            out: dict[str, list] = {f.name: [] for f in _HITS.fields[2:]}
            for text in common.blobs(batch, "text"):
                own = words(text)
                items, places, spans, n_hit = set(), [], [], 0
                found = list(machine.iter(f" {b' '.join(own).decode('latin-1')} ")) if own and len(machine) else []
                if found:
                    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
                    marked = np.zeros(len(own), bool)
                    for end, (width, ids) in found:
                        last = int(np.searchsorted(ends, end))
                        marked[last - width + 1 : last + 1] = True
                        items.update(ids)
                    n_hit, runs = int(marked.sum()), _runs(marked)
                    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
                    places = [p for run in runs for p in run]
                    spans = [[at[a][0], at[b][1]] for a, b in runs]
                for name, value in zip(out, (len(own), n_hit, sorted(items), places, spans), strict=True):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
                names=[f.name for f in _HITS.fields],
            )

    return docs.mapInArrow(scan, _HITS)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """Hits of several automata brought together; equal rows of a document count once per automaton."""

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n_hit, spans = [], []
            for row in batch.select(["places", "all_spans"]).to_pylist():
                marked: set[int] = set()
                for run in row["places"]:
                    for a, b in zip(run[::2], run[1::2], strict=True):
                        marked.update(range(a, b + 1))
                n_hit.append(len(marked))
                # Runs that touch are one span; their words are neighbours.
                ends = sorted((a, b, s, e) for p, q in zip(row["places"], row["all_spans"], strict=True)
                              for a, b, (s, e) in zip(p[::2], p[1::2], q, strict=True))
                merged: list[list[int]] = []
                for a, b, s, e in ends:
                    if merged and a <= merged[-1][1] + 1:
                        if b > merged[-1][1]:
                            merged[-1][1], merged[-1][3] = b, e
                    else:
                        merged.append([a, b, s, e])
                spans.append([[s, e] for _, _, s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text_hash", "n_words")),
                    pa.array(n_hit, pa.int64()),
                    batch.column(batch.schema.get_field_index("items")),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    batch.column(batch.schema.get_field_index("copies")),
                ],
                names=["doc_id", "text_hash", "n_words", "n_hit", "items", "spans", "copies"],
            )

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    grouped = rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_set(F.struct("words", "spans")).alias("hits"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    )
    return (
        grouped.select("doc_id", "text_hash", "n_words", "items", F.col("hits.words").alias("places"),
                       F.col("hits.spans").alias("all_spans"), "copies")
        .mapInArrow(join, "doc_id long, text_hash long, n_words long, n_hit long, items array<string>, "
                          "spans array<array<int>>, copies int")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copy", "copies")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document (doc_id, text_hash): words, hit words, items found, spans (code points) of hit words.

    The windows of the benchmark are measured first. Up to ``automaton_bytes``
    they make one automaton and documents are read once, without a shuffle.
    """
    spark = docs.sparkSession
    windows = common.stage(item_windows(benchmark), "benchmark-windows")
    size = F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64
    total = windows.agg(F.sum(size)).head()[0] or 0
    n_blocks = -(-total // automaton_bytes) or 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.text_hash().alias("text_hash"),
        common.binary("text").alias("text"),
    )
    parts = []
    for block in range(n_blocks):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        parts.append(_scan(rows, _Block(spark, own.collect())))
    found = parts[0] if n_blocks == 1 else _joined(parts)
    return found.select("doc_id", "text_hash", "n_words", "n_hit", "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's."""
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS lower_az FROM documents)),
b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, {_LOWER} AS lower_az FROM benchmark)),
win AS MATERIALIZED (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), {WINDOW}) AS k,
         array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT doc_id, i, k, item_id FROM dw JOIN win USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(contaminated(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark")))
