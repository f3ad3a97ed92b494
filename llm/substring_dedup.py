"""Removal of repeated passages by fixed-block anchors.

Every document is a reference: its blocks of ``BLOCK`` words that start at
multiples of ``BLOCK`` are the index, and every rolling window of ``BLOCK`` words
of every document probes it. A passage of ``WIDTH`` words holds a whole block, so
wherever a passage stands a second time, one of its probes meets a block of the
other place. Only around such hits are the exact passages compared: each hit is
extended to the windows of ``WIDTH`` words that hold it, equal windows meet, all
but the first (by id, then place) are repeats, and neighbouring repeats join to
maximal ones.

Hits travel as answers to ranges of documents (see ``repeats``), which follow the
order of ids; so the first range with a window keeps it, and within a range order decides.

Defined results: null and wordless texts have no words; texts below ``WIDTH``
words lose none; null ids come first; equal ids are ordered by a hash of their
texts, and rows equal in both are one document that gets one result per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, repeats

WIDTH = 20
BLOCK = 10
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _hashes(text: bytes | None, known: common.WordHashes) -> np.ndarray:
    return known.of((text or b"").split())


def _passages(hashes: np.ndarray) -> np.ndarray:
    """96 bits for each window of ``WIDTH`` words."""
    a = common.windows(hashes, WIDTH)
    out = np.empty(len(a), _ENTRY)
    out["a"] = a
    out["b"] = common.windows(_stirred(hashes), WIDTH) >> np.uint64(32)
    return out


def _order(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order that brings equal values together, and which ordered entries are first of theirs."""
    first = np.ones(len(entries), bool)
    order = np.argsort(entries["a"], kind="stable")
    ordered = entries[order]
    same = ordered["a"][1:] == ordered["a"][:-1]
    if (same & (ordered["b"][1:] != ordered["b"][:-1])).any():
        order = np.lexsort((entries["b"], entries["a"]))
        ordered = entries[order]
        same = ordered[1:] == ordered[:-1]
    first[1:] = ~same
    return order, first


def _stirred(hashes: np.ndarray) -> np.ndarray:
    return common.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def _candidates(docs: DataFrame, how: repeats.Plan, answers: DataFrame) -> DataFrame:
    """(fragment, payload): the distinct windows around hits of each range."""

    def extend(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHashes()
        held: dict[int, list[tuple[int, bytes, int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = repeats.batch_of([
                ("fragment", list(held), pa.int64()),
                ("data", [repeats.payload(p) for p in held.values()], pa.binary()),
            ])
            held.clear()
            return out

        for key, given, documents in repeats.ranges_of(rows):
            hits = np.sort(np.frombuffer(b"".join(given), np.uint64) >> np.uint64(4))
            found = []
            for _, _, _, text in documents:
                hashes = _hashes(text, known)
                if len(hits) and len(hashes) >= WIDTH:
                    hit = repeats.among(how.short(common.windows(hashes, BLOCK)), hits) >= 0
                    if hit.any():
                        # A window holds WIDTH - BLOCK + 1 blocks; any of them may be the anchor.
                        seen = np.concatenate(([0], np.cumsum(hit)))
                        wide = WIDTH - BLOCK + 1
                        near = seen[wide:] > seen[:-wide]
                        found.append(_passages(hashes)[near])
            if found:
                entries = np.concatenate(found)
                order, new = _order(entries)
                entries = entries[order][new]
                fragments = (entries["a"] >> np.uint64(64 - how.bits)).astype(np.int64)
                begin, stop = repeats.sorted_groups(fragments)
                for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                    held.setdefault(int(fragments[a]), []).append((key, entries[a:b].tobytes(), b - a))
                size += len(entries)
            if size >= repeats.GATHERED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return repeats.met(docs, answers).mapInArrow(extend, "fragment long, data binary")


def _later(candidates: DataFrame) -> DataFrame:
    """(key, data): windows of a range that also stand in an earlier range."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values in repeats.fragments_of(rows):
            parts = [repeats.parts_of(v) for v in values]
            entries = np.frombuffer(b"".join(p[2] for p in parts), _ENTRY)
            keys = np.repeat(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            order = np.argsort(keys, kind="stable")
            entries, keys = entries[order], keys[order]
            order, first = _order(entries)
            keys, entries = keys[order][~first], entries[order][~first]
            if len(keys):
                order = np.argsort(keys, kind="stable")
                keys, entries = keys[order], entries[order]
                begin, stop = repeats.sorted_groups(keys)
                yield repeats.batch_of([
                    ("key", keys[begin].tolist(), pa.int64()),
                    ("data", [entries[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], pa.binary()),
                ])

    return repeats.gathered(candidates).mapInArrow(compare, "key long, data binary")


def _covered(starts: np.ndarray | None, n_words: int) -> list[tuple[int, int]]:
    """Runs of words that the windows at ``starts`` (sorted) cover."""
    if starts is None or not len(starts):
        return []
    apart = np.flatnonzero(np.diff(starts) > WIDTH)
    begin = np.concatenate((starts[:1], starts[apart + 1]))
    stop = np.concatenate((starts[apart], starts[-1:])) + WIDTH
    return list(zip(begin.tolist(), np.minimum(stop, n_words).tolist(), strict=True))


def _repeats_in(
    windows: list[np.ndarray], hashes: list[np.ndarray], gone: np.ndarray
) -> dict[int, np.ndarray]:
    """By document of a range: starts of the windows that stand in ``gone`` or earlier in the range.

    64 bits pick windows that may be repeats; only those are compared by 96.
    """
    places = [(at, w) for at, w in enumerate(windows) if len(w)]
    if not places:
        return {}
    values = np.concatenate([gone["a"], *(w for _, w in places)])
    order = np.argsort(values, kind="stable")
    equal = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    chosen = np.flatnonzero(twice)
    entries = np.empty(len(chosen), _ENTRY)
    entries["a"] = values[chosen]
    docs, starts, begin = np.full(len(chosen), -1), np.zeros(len(chosen), np.int64), len(gone)
    old = chosen < begin
    entries["b"][old] = gone["b"][chosen[old]]
    for at, w in places:
        low, high = np.searchsorted(chosen, (begin, begin + len(w)))
        if high > low:
            own = chosen[low:high] - begin
            docs[low:high], starts[low:high] = at, own
            entries["b"][low:high] = (common.windows(_stirred(hashes[at]), WIDTH) >> np.uint64(32))[own]
        begin += len(w)
    order, first = _order(entries)
    repeat = np.zeros(len(chosen), bool)
    repeat[order] = ~first
    repeat &= docs >= 0
    docs, starts = docs[repeat], starts[repeat]
    if not len(docs):
        return {}
    low, high = repeats.sorted_groups(docs)
    return {int(docs[a]): starts[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)}


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<array<int>>, kept string, copies long"


def _removed(docs: DataFrame, later: DataFrame, texts: bool) -> DataFrame:
    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHashes()
        for _, given, documents in repeats.ranges_of(rows):
            own = list(documents)
            hashes = [_hashes(text, known) for *_, text in own]
            gone = np.frombuffer(b"".join(given), _ENTRY)
            marks = _repeats_in([common.windows(h, WIDTH) for h in hashes], hashes, gone)
            out: list[list] = [[] for _ in range(7)]
            for at, (doc_id, _, copies, text) in enumerate(own):
                words = (text or b"").split()
                runs = _covered(marks.get(at), len(words))
                kept, place = [], 0
                for start, stop in runs:
                    kept += words[place:start]
                    place = stop
                kept = b" ".join(kept + words[place:] if runs else words)
                value = (
                    doc_id, len(words), sum(stop - start for start, stop in runs), hashlib.sha256(kept).hexdigest(), [list(r) for r in runs],
                    kept.decode("utf-8", "replace") if texts else None, copies,
                )
                for column, v in zip(out, value, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string(), pa.int64()]
            names = [c.split()[0] for c in _RESULT.split(", ")]
            yield repeats.batch_of(list(zip(names, out, kinds, strict=True)))

    return repeats.met(docs, later).mapInArrow(remove, _RESULT)


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (first word, word after the last) and the kept text."""
    how = repeats.plan(docs)
    rows = repeats.keyed(docs)

    def probes(text: bytes | None, known: common.WordHashes = common.WordHashes()) -> tuple[np.ndarray, np.ndarray]:
        found = common.windows(_hashes(text, known), BLOCK)
        return found, np.arange(len(found)) % BLOCK == 0

    answers = common.stage(repeats.repeated(rows, how, probes), "anchors", free=True)
    later = common.stage(_later(_candidates(rows, how, answers)), "repeats", free=True)
    found = repeats.copied(_removed(rows, later, texts))
    return found if texts else found.drop("kept")


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH}))),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM s WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM c GROUP BY doc_id),
x AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(common.table(spark, folder, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
