"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows outside the held-out part are sampled (at most ``TRAINING``) and
split three ways by a seeded hash: one part learns a lexicon of word beginnings
that speak for a toxic text, one fits the trees, one calibrates them. Features of
every whole text are densities of both lexicons, nearness of lexicon words to the
second person, capitals, punctuation and obfuscation.

Defined results: null, empty and wordless texts get the features of no words and
a score like any other; several labels of one document count as toxic if one
does; null labels are not learned; without both classes the score is the share
of toxic labels (0 without labels); repeated documents each get their row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

#: Most labelled rows that are learned from, and most entries of the learned lexicon.
TRAINING = 24_000
LEXICON = 2_000
TREES, DEPTH, STEP = 20, 4, 0.3
SEED = "toxicity"
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 5

# Common insults and second-person words of four languages.
INSULTS = (
    "idiot stupid moron loser trash scum pathetic disgusting worthless clown dumb fool ugly jerk "
    "dumm trottel abschaum widerlich wertlos versager stupide imbécile ordure minable dégoûtant "
    "idiota estúpido imbécil basura asqueroso patético"
).split()
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros"
).split()
# Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = [
    "words", "insult_density", "lexicon_density", "lexicon_hits", "lexicon_weight", "lexicon_top", "near_second",
    "second_density", "capitals", "capital_words", "exclamations", "questions", "punctuation", "digits", "obfuscated",
    "stretched",
]
_NOT_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))
_SIGNED = re.compile(rb"[A-Za-z][0-9@$*]+[A-Za-z]|[0-9@$]+[A-Za-z]+[0-9@$]+[A-Za-z]")
_STRETCHED = re.compile(rb"([A-Za-z])\1\1")
_SIGN_TABLE = bytes(ord(SIGNS.get(chr(c), chr(c))) for c in range(256))


def plain_word(word: bytes) -> tuple[str, bool]:
    """A word's letters in lower case, and whether signs stood among them."""
    signed = bool(_SIGNED.search(word))
    if signed:
        word = word.translate(_SIGN_TABLE)
    return word.translate(None, _NOT_LETTERS).decode("utf-8", "replace").lower(), signed


def beginnings(word: str) -> set[str]:
    """What the lexicon knows a word by: its first 4 to 6 letters, and the whole."""
    return {word[:n] + "-" for n in (4, 5, 6) if len(word) >= n} | {word} if word else set()


def learn_lexicon(docs: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Beginnings whose documents are toxic more often, with the lower bound of their log odds.

    ``docs`` has ``text`` and ``toxic``. Documents are counted per beginning over
    all given rows; of the bounded result the surest ``most`` are kept.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(common.blobs(batch, "text"), common.blobs(batch, "toxic"), strict=True):
                own: set[str] = {""}
                for word in set((text or b"").split()):
                    own |= beginnings(plain_word(word)[0])
                seen[int(toxic)].update(own)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()),
                 pa.array([seen[1][k] for k in keys], pa.int64())],
                names=["key", "clean", "toxic"],
            )

    counts = (
        docs.select(common.binary("text").alias("text"), F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(count, "key string, clean long, toxic long")
        .groupBy("key")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    counts = common.stage(counts.where((F.col("toxic") >= 4) | (F.col("key") == "")), "toxicity-counts")
    total = counts.where("key = ''").head()
    if total is None or not total.toxic or not total.clean:
        return {}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / b) - math.log((total.toxic + 1) / (total.clean + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    rows = (
        counts.where("key <> ''").withColumn("odds", odds).where("odds > 0.7")
        .orderBy(F.desc("odds"), "key").limit(most).collect()
    )
    return {r.key: float(r.odds) for r in rows}


class _Words(dict):
    """Code of a word: second person, insult and learned weight, obfuscated, stretched; memorised."""

    MOST = 200_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.insults, self.second = set(INSULTS), set(SECOND_PERSON)

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.MOST:
            self.clear()
        plain, signed = plain_word(word)
        weight = max((self.lexicon.get(k, 0.0) for k in beginnings(plain)), default=0.0)
        flags = (plain in self.second) + 2 * (plain in self.insults) + 4 * signed + 8 * bool(_STRETCHED.search(word))
        # Weight below 64 in sixteenths, flags above: one exact float.
        value = self[word] = flags * 1024.0 + min(round(weight * 16), 1023)
        return value


def features_of(text: bytes | None, codes: _Words) -> list[float]:
    own = (text or b"").split()
    n = len(own)
    signs = np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)
    upper, lower = int(signs[65:91].sum()), int(signs[97:123].sum())
    size = max(1, len(text or b""))
    code = np.fromiter(map(codes.__getitem__, own), np.float64, n)
    flags = (code // 1024).astype(np.int64)
    weight = (code % 1024) / 16
    hits = (weight > 0) | (flags & 2 > 0)
    places = np.flatnonzero(hits)
    second = np.flatnonzero(flags & 1)
    near = 0
    if len(places) and len(second):
        at = np.searchsorted(second, places)
        left = places - second[np.maximum(at - 1, 0)]
        right = second[np.minimum(at, len(second) - 1)] - places
        near = int(((np.abs(left) <= NEAR) | (np.abs(right) <= NEAR)).sum())
    per = max(1, n)
    capital_words = sum(map(bytes.isupper, own))
    return [
        math.log1p(n), int((flags & 2 > 0).sum()) / per, len(places) / per, math.log1p(len(places)),
        float(weight.sum()) / per, float(weight.max()) if n else 0.0, near / max(1, len(places)), len(second) / per,
        upper / max(1, upper + lower), capital_words / per, int(signs[33]) / per, int(signs[63]) / per,
        int(signs[33:48].sum() + signs[58:65].sum() + signs[91:97].sum() + signs[123:127].sum()) / size,
        int(signs[48:58].sum()) / size, int((flags & 4 > 0).sum()) / per, int((flags & 8 > 0).sum()) / per,
    ]


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, text_hash and one column per feature for every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Words(shared.value)
        for batch in common.batches(rows):
            found = np.array([features_of(t, codes) for t in common.blobs(batch, "text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(len(FEATURES)))],
                names=[*batch.schema.names[:-1], *FEATURES],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("text_hash"), common.binary("text").alias("text")
    )
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), *(T.StructField(name, T.DoubleType()) for name in FEATURES)]
    )
    return rows.mapInArrow(measure, schema)


def training_rows(labels: DataFrame, most: int = TRAINING, seed: str = SEED) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out part, in three parts.

    ``part`` is ``words`` (half), ``trees`` or ``scale``.
    """
    digit = F.conv(F.substring("key", 31, 2), 16, 10).cast("int")
    part = F.when(digit < 115, "words").when(digit < 205, "trees").otherwise("scale")
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(5, 0))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .withColumn("key", common.seeded(seed))
    )
    return common.at_most(known, most, "key", "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), "toxic", part.alias("part")
    )


def score(docs: DataFrame, labels: DataFrame, training: int = TRAINING, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, score and predicted for every document, learned from ``labels`` (doc_id, toxic)."""
    known = common.stage(training_rows(labels, training, seed), "toxicity-labels")
    # ``training`` ids and labels at most: less than a megabyte.
    texts = docs.select("doc_id", "text").join(F.broadcast(known.where("part = 'words'")), "doc_id").select("text", "toxic")
    measured = common.stage(features(docs, learn_lexicon(texts)), "toxicity-features")
    rows = measured.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", *FEATURES])
    rows = common.stage(rows, "toxicity-training").coalesce(4)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    classes = {r.toxic: r.n for r in rows.where("part = 'trees'").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        share = known.agg(F.avg("toxic")).head()[0] or 0.0
        scored = measured.select("doc_id", "text_hash", F.lit(float(share)).alias("score"))
    else:
        trees = GBTClassifier(
            featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1
        ).fit(assemble.transform(rows.where("part = 'trees'")))
        chance = lambda part: trees.transform(assemble.transform(part)).withColumn(
            "chance", vector_to_array("probability")[1]
        )
        scale = chance(rows.where("part = 'scale'")).select("chance", F.col("toxic").cast("double").alias("label"))
        if scale.agg(F.countDistinct("label")).head()[0] == 2:
            steps = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(scale)
            scored = steps.transform(chance(measured)).select("doc_id", "text_hash", "score")
        else:
            scored = chance(measured).select("doc_id", "text_hash", F.col("chance").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    scored = score(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    return scored.select("doc_id", common.held_out(5, 0).alias("held_out"), "score", "predicted")
