"""Language identification with string kernels.

A text is the set of its byte n-grams of lengths 1 to ``ORDERS`` (blended
spectrum, presence only), hashed to ``BUCKETS`` places. The kernel of two texts
is the cosine of their sets. Landmark texts span a Nyström space; in it one
ridge regression per language separates that language from the rest. As kernel
values against landmarks are products with their presence rows, landmarks,
Nyström map and regressions fold into one matrix, and a batch of documents is
scored by one product with it.

Fitting takes a seeded sample: at most ``TRAINING`` rows altogether, the same
number for each language. Scoring covers every whole text.

Defined results: a null text or one without a letter is ``und`` with score 0, so
is every text if nothing can be learned; null languages are not learned; equal
scores go to the language first in order; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common

ORDERS = 4
BUCKETS = 1 << 16
#: Most rows that are learned from, over all languages, and landmarks among them.
TRAINING = 1200
LANDMARKS = 160
RIDGE = 1e-2
SEED = "language"
#: Documents scored by one product: bounds a worker's matrix to 32 MB.
SCORED = 128
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: bytes | None) -> bytes | None:
    """Words of letters joined by blanks, or None where the text has no letter."""
    if not text:
        return None
    plain = b" ".join(text.translate(_PLAIN).split())
    if not plain:
        return None
    if plain.isascii() or any(97 <= c <= 122 for c in plain) or any(map(str.isalpha, plain.decode("utf-8", "replace"))):
        return b" " + plain + b" "
    return None


def presence(plain: bytes, row: np.ndarray) -> None:
    """Set the places of a text's n-grams in ``row``."""
    own = np.frombuffer(plain, np.uint8).astype(np.uint32)
    gram = own
    for order in range(ORDERS):
        if order:
            gram = gram[:-1] * np.uint32(0x01000193) + own[order:]
        row[(gram * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16)] = 1


def _sample(docs: DataFrame, most: int, seed: str) -> list:
    """(lang, presence bits) of a seeded sample with equal parts; texts stay in the tasks."""
    named = docs.where(F.col("lang").isNotNull())
    # One row per language; of each only keys in the range that holds half as many
    # again as are wanted meet, so no task gathers more of one language than that.
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    each = max(1, most // len(sizes))
    ends = [(lang, 2**32 if n <= 2 * each else int(1.5 * each / n * 2**32) + 1) for lang, n in sorted(sizes.items())]
    limits = docs.sparkSession.createDataFrame(ends, "lang string, end long")
    first = W.partitionBy("lang").orderBy("key", "doc_id")
    chosen = (
        named.select("lang", "doc_id", common.seeded(seed).alias("key"))
        .join(F.broadcast(limits), "lang")
        .where(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") < F.col("end"))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= each)
        .select("lang", "doc_id")
        .distinct()
    )

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            keep, packed = [], []
            for at, text in enumerate(common.blobs(batch, "text")):
                if (plain := letters(text)) is not None:
                    row = np.zeros(BUCKETS, np.uint8)
                    presence(plain, row)
                    keep.append(at)
                    packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())),
                 pa.array(packed, pa.binary())],
                names=["lang", "doc_id", "bits"],
            )

    # At most ``most`` ids: a bound of some kilobytes.
    rows = named.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "doc_id", common.binary("text").alias("text"))
    return (
        rows.mapInArrow(bits, "lang string, doc_id long, bits binary")
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("doc_id", "bits")))
        .where(F.col("place") <= each)
        .orderBy("place", "lang")
        .collect()
    )


def fit(docs: DataFrame, training: int = TRAINING, landmarks: int = LANDMARKS, ridge: float = RIDGE,
        seed: str = SEED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, matrix (places by languages) and offsets, learned from ``text`` and ``lang``."""
    rows = _sample(docs, training, seed)
    langs = sorted({r.lang for r in rows})
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32)
    bits = [np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows]
    sizes = np.sqrt(np.array([b.sum() for b in bits], np.float64))
    marks = np.stack(bits[:landmarks]).astype(np.float32) / sizes[:landmarks, None].astype(np.float32)
    kernel = np.concatenate(
        [np.stack(bits[at : at + SCORED]).astype(np.float32) @ marks.T for at in range(0, len(bits), SCORED)]
    ).astype(np.float64) / sizes[:, None]
    values, vectors = np.linalg.eigh(kernel[: len(marks)])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel @ whiten
    wanted = np.where(np.array([r.lang for r in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    middle, level = mapped.mean(0), wanted.mean(0)
    centred = mapped - middle
    weights = np.linalg.solve(
        centred.T @ centred + ridge * len(rows) * np.eye(centred.shape[1]), centred.T @ (wanted - level)
    )
    return langs, (marks.T @ (whiten @ weights)).astype(np.float32), (level - middle @ weights).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (share of the best language among all, 0 to 1)."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1:])

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, offsets = shared.value
        for batch in common.batches(rows, SCORED):
            plain = [letters(text) for text in common.blobs(batch, "text")]
            present = np.zeros((len(plain), BUCKETS), np.float32)
            for row, own in zip(present, plain, strict=True):
                if own is not None:
                    presence(own, row)
            if langs:
                size = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
                margins = (present @ matrix) / size + offsets
                best = margins.argmax(1)
                odds = np.exp(3.0 * (margins - margins.max(1, keepdims=True)).astype(np.float64))
                top = 1.0 / odds.sum(1)
            known = [bool(langs) and own is not None for own in plain]
            names = [langs[best[at]] if ok else "und" for at, ok in enumerate(known)]
            scores = [float(top[at]) if ok else 0.0 for at, ok in enumerate(known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out"), common.binary("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").withColumn("held_out", common.held_out(3, 1))
    return predict(docs, fit(docs.where(~F.col("held_out"))))
