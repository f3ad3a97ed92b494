"""Which hashed items of documents occur in more than one place.

Documents are taken in ranges (``key``): they are put in order of id and hash once,
and every ``RANGE_DOCS`` neighbours are a range, however ids are spread; rows equal
in both are one document with a number of copies. A map task sends, per range and
item, one entry of five bytes: 38 bits of the item's hash and two marks (starts
on a block boundary; several places within the range). Entries are dealt by the
leading bits of the hash, the *fragment*; each fragment is sorted on its own and
answers every range with the items that also occur elsewhere. So an item that a
third of all documents share costs an entry per range, not per document, and no
list of places is ever gathered. Truncated hashes may name a few items too many
(about one in 65,000); callers check exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

LOW = 38
#: Bytes of text that one fragment's entries come from, about; bounds a task's memory.
FRAGMENT_BYTES = 12 << 20
#: Documents of one range, at most.
RANGE_DOCS = 128
#: Items that a map task gathers before it sends them.
GATHERED = 1_500_000


@dataclass(frozen=True)
class Plan:
    """The number of leading bits that name a fragment."""

    bits: int

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - LOW - self.bits)


def plan(docs: DataFrame) -> Plan:
    """Fragments from the documents' bytes (one narrow row)."""
    (size,) = docs.agg(F.sum(F.octet_length("text"))).head()
    return Plan(min(24, max(6, ((size or 0) // FRAGMENT_BYTES).bit_length())))


def keyed(docs: DataFrame) -> DataFrame:
    """key (range), doc_id, text_hash, copies and the text's bytes (``data``), staged in order.

    Rows equal in id and hash are brought together first, map tasks combining their
    own, so they cost one document. Then rows are range-partitioned by id (null
    first) and hash. A range is numbered by partition and place within it: ranges
    follow one another as their documents do, and no id is reckoned with.
    """
    doc_id = F.col("doc_id").cast("long")
    by = ["has_id", "id", "text_hash"]
    single = (
        docs.select(
            doc_id.isNotNull().alias("has_id"), F.coalesce(doc_id, F.lit(0)).alias("id"),
            common.text_hash().alias("text_hash"), common.binary("text").alias("data"),
        )
        .groupBy(*by).agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    )
    # Partition above, place in the lowest 33 bits.
    number, low = F.monotonically_increasing_id(), 2**33
    place = F.floor(number.bitwiseAND(F.lit(low - 1)) / RANGE_DOCS)
    ordered = single.repartitionByRange(*by).sortWithinPartitions(*by).select(
        (F.shiftright(number, 33) * low + place).cast("long").alias("key"),
        F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "text_hash", "copies", "data",
    )
    return common.stage(ordered, "ranges", free=True)


def copied(rows: DataFrame) -> DataFrame:
    """Every row as often as its ``copies`` say, which are dropped; no array of them all is made."""
    step = 4096
    return (
        rows.withColumn("copies_", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(step))))
        .withColumn("copies_", F.explode(F.sequence(F.col("copies_"), F.least(F.col("copies") - 1, F.col("copies_") + step - 1))))
        .drop("copies", "copies_")
    )


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def payload(parts: list[tuple[int, bytes, int]]) -> bytes:
    """Entries of several keys in one value: (key, bytes, number) each."""
    keys = np.array([p[0] for p in parts], np.int64)
    counts = np.array([p[2] for p in parts], np.int64)
    return np.int64(len(parts)).tobytes() + keys.tobytes() + counts.tobytes() + b"".join(p[1] for p in parts)


def parts_of(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    return head[:n], head[n:], data[8 + 16 * n :]


def fragments_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Values of each fragment, which come sorted by fragment."""
    now, held = None, []
    for batch in rows:
        for fragment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if fragment != now and held:
                yield now, held
                held = []
            now = fragment
            held.append(data)
    if held:
        yield now, held


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of (fragment, payload) with each fragment's rows together."""
    return rows.repartition("fragment").sortWithinPartitions("fragment")


def batch_of(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for _, v, k in columns], names=[n for n, _, _ in columns])


def sorted_groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], edges)), np.concatenate((edges, [len(values)]))


def repeated(
    docs: DataFrame, how: Plan, items: Callable[[bytes | None], tuple[np.ndarray, np.ndarray | None]]
) -> DataFrame:
    """(key, data): per range and fragment, the items that occur elsewhere too.

    ``items`` gives a text's hashes and which of them start on a block boundary
    (None: all). An item counts as repeated if it occurs twice at least, once on
    a boundary. ``data`` holds 8 bytes per item: its shortened hash above, in the
    lowest 4 bits the logarithm of the number of ranges it occurs in.
    """

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            by_fragment: dict[int, list[tuple[int, bytes, int]]] = {}
            for key, arrays in held.items():
                marked = np.sort(np.concatenate(arrays))
                starts, ends = sorted_groups(marked >> np.uint64(1))
                short = marked[starts] >> np.uint64(1)
                entries = (
                    ((short & np.uint64((1 << LOW) - 1)) << np.uint64(2))
                    | ((marked[ends - 1] & np.uint64(1)) << np.uint64(1))
                    | (ends - starts > 1).astype(np.uint64)
                )
                fragments = (short >> np.uint64(LOW)).astype(np.int64)
                begin, stop = sorted_groups(fragments)
                for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                    by_fragment.setdefault(int(fragments[a]), []).append((key, _pack(entries[a:b], 5), b - a))
            held.clear()
            return batch_of([
                ("fragment", list(by_fragment), pa.int64()),
                ("data", [payload(p) for p in by_fragment.values()], pa.binary()),
            ])

        for batch in common.batches(rows):
            for key, text in zip(common.blobs(batch, "key"), common.blobs(batch, "data"), strict=True):
                hashes, aligned = items(text)
                if len(hashes):
                    marks = np.uint64(1) if aligned is None else aligned.astype(np.uint64)
                    held.setdefault(key, []).append((how.short(hashes) << np.uint64(1)) | marks)
                    size += len(hashes)
            if size >= GATHERED:
                yield flush()
                size = 0
        if held:
            yield flush()

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, values in fragments_of(rows):
            parts = [parts_of(v) for v in values]
            entries = _unpack(b"".join(p[2] for p in parts), 5)
            keys = np.repeat(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            order = np.argsort(entries >> np.uint64(2), kind="stable")
            entries, keys = entries[order], keys[order]
            starts, ends = sorted_groups(entries >> np.uint64(2))
            aligned = np.bitwise_or.reduceat(entries, starts) & np.uint64(2) > 0
            several = (ends - starts > 1) | (np.bitwise_or.reduceat(entries, starts) & np.uint64(1) > 0)
            hit = np.repeat(aligned & several, ends - starts)
            level = np.minimum(15, np.log2(ends - starts).astype(np.int64)).astype(np.uint64)
            values = (
                ((np.uint64(fragment << LOW) | (entries >> np.uint64(2))) << np.uint64(4)) | np.repeat(level, ends - starts)
            )[hit]
            keys = keys[hit]
            if len(keys):
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                begin, stop = sorted_groups(keys)
                yield batch_of([
                    ("key", keys[begin].tolist(), pa.int64()),
                    ("data", [values[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary()),
                ])

    sent = docs.select("key", "data").mapInArrow(send, "fragment long, data binary")
    return gathered(sent).mapInArrow(answer, "key long, data binary")


def met(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents behind the answers to their range: rows (key, kind, doc_id, text_hash, copies, data), sorted.

    ``kind`` is 0 for answers and 1 for documents; within a range documents come
    by id (null first) and hash.
    """
    nothing = F.lit(None).cast("long")
    return (
        docs.select("key", F.lit(1).alias("kind"), "doc_id", "text_hash", "copies", "data")
        .unionByName(answers.select(
            "key", F.lit(0).alias("kind"), *[nothing.alias(n) for n in ("doc_id", "text_hash", "copies")], "data"
        ))
        .repartition("key")
        .sortWithinPartitions("key", "kind", F.col("doc_id").asc_nulls_first(), "text_hash")
    )


def ranges_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], Iterator[tuple]]]:
    """For each range: its answers, then its documents (doc_id, text_hash, copies, text) as a stream."""

    def flat() -> Iterator[tuple]:
        names = ("key", "kind", "doc_id", "text_hash", "copies", "data")
        for batch in common.batches(rows, 512):
            yield from zip(*(common.blobs(batch, n) for n in names), strict=True)

    stream = flat()
    row = next(stream, None)
    while row is not None:
        key, answers = row[0], []
        while row is not None and row[0] == key and row[1] == 0:
            answers.append(row[-1])
            row = next(stream, None)

        def documents() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                now, row = row, next(stream, None)
                yield now[2:]

        yield key, answers, documents()
        while row is not None and row[0] == key:
            row = next(stream, None)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)
