"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases (each the longest known
phrase and one byte more). The set of phrases is hashed and kept as ``HASHES``
minima of 8 bits each. The share of equal minima, less what is equal by chance,
estimates how many phrases two texts have in common, as a shared dictionary would
compress them.

``fingerprints`` needs no shuffle. ``neighbours`` also compares every document
with an edited text and with the next document (descending id): documents are
range-partitioned and sorted once; each partition is read as a stream that holds
two documents at a time, and its last document meets the first of the next
partition in a second step over one row per partition.

Defined results: null counts as empty; an empty text has the fingerprint '' and
is alike (1) to empty texts only; null ids come last in order; equal ids are
ordered by a hash of their texts; a single document is its own next one. A worker
holds two documents and their trees, some 60 bytes for each byte of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

HASHES = 128
_STEP = 0x9E3779B97F4A7C15
_PARTS = np.arange(HASHES)
_EDGES = _PARTS.astype(np.uint64) << np.uint64(64 - (HASHES - 1).bit_length())


#: Bytes whose phrases are hashed together (or one phrase, if that is longer).
CHUNK = 1 << 18


class Parse:
    """State of a parse: the dictionary as a tree, and where phrases end.

    The tree is one flat table: a node is a multiple of 256, and node + byte leads
    to the node below. It takes some 25 bytes for each byte of text.
    """

    def __init__(self) -> None:
        self.tree: dict[int, int] = {}
        self.at, self.size = 0, 0
        self.ends: list[int] = []

    def _read(self, data: bytes) -> tuple[int, list[int]]:
        tree, node, ends = self.tree, self.at, []
        known, note, new = tree.get, ends.append, len(tree) << 8
        for place, byte in enumerate(data, self.size + 1):
            key = node + byte
            node = known(key)
            if node is None:
                new += 256
                tree[key] = new
                note(place)
                node = 0
        return node, ends

    def read(self, data: bytes) -> Parse:
        self.at, ends = self._read(data)
        self.ends += ends
        self.size += len(data)
        return self

    def ends_with(self, data: bytes) -> list[int]:
        """Phrase ends if ``data`` came next; the state stays as it is."""
        _, ends = self._read(data)
        for _ in ends:
            # Entries leave in the opposite order of their coming.
            self.tree.popitem()
        return self.ends + ends


def _hashes(data: bytes, ends: list[int]) -> np.ndarray:
    """One hash for each phrase, from differences of a running sum; the sum is made chunk by chunk."""
    stops, found, low, begin = np.array(ends, np.int64), [], 0, 0
    while low < len(stops):
        high = max(low + 1, int(np.searchsorted(stops, begin + CHUNK, "right")))
        stop = stops[low:high] - begin
        own = np.frombuffer(data, np.uint8, int(stop[-1]), begin).astype(np.uint64) + np.uint64(1)
        powers, inverses = common.POWERS.of(len(own))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * powers, out=sums[1:])
        start = np.concatenate((np.zeros(1, np.int64), stop[:-1]))
        found.append(common.mix((sums[stop] - sums[start]) * inverses[start]))
        low, begin = high, int(stops[high - 1])
    return np.concatenate(found)


def signature(data: bytes, ends: list[int]) -> np.ndarray | None:
    """Minima (8 bits each) over the hashes of the phrases that end at ``ends``; one hash per phrase."""
    if not ends:
        return None
    phrases = np.sort(_hashes(data, ends))
    # The hash range is cut into HASHES parts; each part's least phrase is a minimum.
    at = np.searchsorted(phrases, _EDGES)
    least = phrases[np.minimum(at, len(phrases) - 1)]
    full = np.flatnonzero(np.diff(np.append(at, len(phrases))) > 0)
    # An empty part takes the minimum of the next full one, stirred with the distance.
    next_full = full[np.searchsorted(full, _PARTS) % len(full)]
    distance = ((next_full - _PARTS) % HASHES).astype(np.uint64)
    return (common.mix(least[next_full] + distance * np.uint64(_STEP)) & np.uint64(0xFF)).astype(np.uint8)


def as_bytes(minima: np.ndarray | None) -> bytes:
    return b"" if minima is None else minima.tobytes()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return max(0.0, (float((a == b).mean()) - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    return as_bytes(signature(data, Parse().read(data).ends)).hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            found = [fingerprint(text) for text in common.blobs(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fingerprint string")


class _Doc:
    """A document parsed to its half and to its end."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.n = len(self.text)
        self.changed = self.n // 2
        self.head = self.text[: self.n - self.changed].encode()
        tail = self.text[self.n - self.changed :].encode()
        self.half = Parse().read(self.head)
        self.minima = signature(self.head + tail, self.half.ends_with(tail))

    def against(self, following: _Doc) -> tuple:
        new = following.text[: self.changed].encode()
        edited = signature(self.head + new, self.half.ends_with(new))
        return (
            self.doc_id, self.n, hashlib.sha256(self.head + new).digest(), as_bytes(self.minima), as_bytes(edited),
            likeness(self.minima, edited), likeness(self.minima, following.minima),
        )


#: Hashes stay bytes in written tables, half of what their text would take.
_COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, its edited text's, and how alike it is to that and to the next."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def stream(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def batch(found: list[tuple], kind: str, text: str | None) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [*_arrays(found), pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int64()),
                 pa.array([text] * n, pa.string())],
                names=[*names, "kind", "part", "text"],
            )

        def edge(doc: _Doc, kind: str) -> pa.RecordBatch:
            return batch([(doc.doc_id, *[None] * 6)], kind, doc.text)

        last: _Doc | None = None
        for given in common.batches(rows, 256):
            found = []
            for doc_id, text in zip(common.blobs(given, "doc_id"), common.blobs(given, "text"), strict=True):
                doc = _Doc(doc_id, text)
                if last is None:
                    yield edge(doc, "head")
                else:
                    found.append(last.against(doc))
                last = doc
            if found:
                yield batch(found, "row", None)
        if last is not None:
            yield edge(last, "tail")

    def close(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in rows:
            for row in given.to_pylist():
                pair = _Doc(row["doc_id"], row["text"]).against(_Doc(None, row["next_text"]))
                yield pa.RecordBatch.from_arrays(_arrays([pair]), names=names)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id").desc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )
    done = common.stage(
        ordered.mapInArrow(stream, f"{_COLUMNS}, kind string, part long, text string"), "lz-fingerprints"
    )
    # One row per partition from here on.
    heads = done.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    order = W.orderBy("part")
    tails = done.where("kind = 'tail'").select("part", "doc_id")
    following = tails.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())).alias("next_part")
    )
    edges = (
        done.where("kind = 'tail'").select("part", "doc_id", "text").join(following, "part").join(heads, "next_part")
        .select("doc_id", "text", "next_text")
        .mapInArrow(close, _COLUMNS)
    )
    whole = done.where("kind = 'row'").select(*names).unionByName(edges)
    return whole.withColumns(
        {n: F.lower(F.hex(n)) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(common.table(spark, folder, "documents"))
