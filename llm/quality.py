"""Document quality by co-training of two views.

One classifier sees the text's content (words, signs, function words,
repetition), the other the page's metadata (source, language, size, layout, stored
size, and address and markup of the page of that id where ``pages`` has one).
Both start from a seeded, bounded sample of labels. In each of ``ROUNDS`` rounds
each view scores all documents without a label and names the ``EXCHANGED`` of each
class that it is surest of, and the *other* view learns them as further labels.
Each view is then calibrated on labels that neither has learned, and the
calibrated log odds are added to score every document.

Defined results: null and empty texts get the features of no words; missing
metadata counts as 0; several labels of one document count as good if one does;
without labels of both classes every score is the share of good ones (0.5
without any); of several pages with one id the largest values count; equally sure
documents are taken by their hash, and rows equal in id and text as one; repeated
documents each get their row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common

#: Most labelled rows that are fitted on.
TRAINING = 16_000
ROUNDS = 3
#: Documents that a view hands over per round and class, the surest of all, and how sure it has to be.
EXCHANGED, SURE = 400, 0.95
SEED = "quality"
BUCKETS = 16

# Function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it with as by on are this der die und das von zu den mit ist im nicht ein eine auf "
    "le la les de des et un une du en que qui dans pour par sur el los las y del se con una no".split()
)
CONTENT = [
    "words", "word_length", "distinct", "top_word", "capitals", "capital_words", "symbols", "symbol_words", "marks",
    "sentence_ends", "digits", "function_words", "repeated_pairs",
]
LAYOUT = ["chars", "lines", "line_length", "repeated_lines", "ended_lines", "bytes_per_char", "stored"]
PAGE = ["page_markup", "page_depth", "page_query", "page_secure"]
_SCHEMA = ["doc_id", "text_hash", "source", "lang"]


def content_of(text: bytes) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    plain = [w.strip(b".,;:!?").lower() for w in words]
    counts = Counter(plain)
    pairs = Counter(zip(plain, plain[1:], strict=False))
    signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(signs[65:91].sum()), int(signs[97:123].sum())
    symbols = int(sum(signs[c] for c in b"#$%&*@|<>{}[]^~\\_=+"))
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n,
        max(counts.values(), default=0) / n, upper / max(1, upper + lower), sum(map(bytes.isupper, words)) / n,
        symbols / size, sum(any(c in w for c in b"#$%&*@|") for w in words) / n, int(signs[33]) / n,
        int(signs[46] + signs[63]) / n, int(signs[48:58].sum()) / size,
        sum(counts[w.encode()] for w in FUNCTION_WORDS) / n, 1 - len(pairs) / max(1, len(words) - 1),
    ]


def layout_of(text: bytes) -> list[float]:
    lines = [line for line in text.split(b"\n") if line]
    n, size = max(1, len(lines)), max(1, len(text))
    chars = sum(1 for _ in text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    return [
        math.log1p(chars), math.log1p(len(lines)), math.log1p(size / n), 1 - len(set(lines)) / n,
        sum(line.endswith((b".", b"!", b"?")) for line in lines) / n, size / max(1, chars),
        len(zlib.compress(text, 1)) / (size + 16),
    ]


def views(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash and the arrays ``content`` and ``page`` of every document."""

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            content, layout = [], []
            for text, source, lang in zip(*(common.blobs(batch, k) for k in ("text", "source", "lang")), strict=True):
                content.append(content_of(text or b""))
                places = [0.0] * (2 * BUCKETS)
                for at, name in enumerate((source, lang)):
                    if name is not None:
                        places[at * BUCKETS + zlib.crc32(name.encode()) % BUCKETS] = 1.0
                layout.append(layout_of(text or b"") + places)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, kind), pa.array(layout, kind)],
                names=["doc_id", "text_hash", "content", "page"],
            )

    field = lambda name: F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("text_hash"), field("source").alias("source"),
        field("lang").alias("lang"), common.binary("text").alias("text"),
    )
    found = rows.mapInArrow(measure, "doc_id long, text_hash long, content array<double>, page array<double>")
    empty = F.array(*[F.lit(0.0)] * len(PAGE))
    if pages is None:
        return found.withColumn("page", F.concat("page", empty))
    path = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*|[?#].*$", "")
    facts = pages.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("long").alias("doc_id")).agg(
        F.max(F.log1p(F.coalesce(F.octet_length("html"), F.lit(0)))).alias("a"),
        F.max(F.coalesce(F.regexp_count(path, F.lit("/[^/]")), F.lit(0)).cast("double")).alias("b"),
        F.max(F.coalesce(F.col("url").contains("?"), F.lit(False)).cast("double")).alias("c"),
        F.max(F.coalesce(F.col("url").startswith("https"), F.lit(False)).cast("double")).alias("d"),
    )
    facts = facts.select("doc_id", F.array("a", "b", "c", "d").alias("facts"))
    joined = common.stage(found, "quality-views").join(facts, "doc_id", "left")
    return joined.select("doc_id", "text_hash", "content", F.concat("page", F.coalesce("facts", empty)).alias("page"))


class View:
    """Logistic regression on scaled features, with a calibration of its log odds."""

    def __init__(self, x: np.ndarray) -> None:
        self.middle, self.width = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.weights = np.zeros(x.shape[1] + 1)
        self.scale, self.shift = 1.0, 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.width, -8, 8)
        return self.scale * (z @ self.weights[:-1] + self.weights[-1]) + self.shift

    @staticmethod
    def _solve(z: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z.T * v) @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        z = np.hstack([np.clip((x - self.middle) / self.width, -8, 8), np.ones((len(x), 1))])
        ridge = np.ones(z.shape[1])
        ridge[-1] = 1e-6
        self.scale, self.shift, self.weights = 1.0, 0.0, self._solve(z, y, ridge)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        self.scale, self.shift = 1.0, 0.0
        raw = self.odds(x)
        # Targets a little off 0 and 1, by the number of rows, so that the odds stay finite.
        n_good = y.sum()
        aim = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (len(y) - n_good + 2))
        self.scale, self.shift = self._solve(np.stack([raw, np.ones(len(raw))], 1), aim, np.array([1e-3, 1e-3]))
        return self


#: The surest documents in a view's eyes: (view number, view, good or not, how many) to
#: (key, both views' features) of each, surest first.
Surest = Callable[[int, View, bool, int], list[tuple[object, tuple[np.ndarray, np.ndarray]]]]


def co_train(
    labelled: tuple[np.ndarray, np.ndarray, np.ndarray], check: tuple[np.ndarray, np.ndarray, np.ndarray],
    surest: Surest, rounds: int = ROUNDS, exchanged: int = EXCHANGED,
) -> tuple[View, View]:
    """Both views after ``rounds`` exchanges; each tuple holds both views' rows (and labels).

    What a view has been given once it is not given again; so many more are asked for.
    """
    ends = []
    own = [(labelled[v], labelled[2]) for v in (0, 1)]
    taken: list[set] = [set(), set()]
    for turn in range(rounds + 1):
        ends = [View(labelled[v]).fit(*own[v]).calibrate(check[v], check[2]) for v in (0, 1)]
        if turn == rounds:
            break
        given = []
        for v in (0, 1):
            other = 1 - v
            for good in (True, False):
                new = {}
                for key, x in surest(v, ends[v], good, exchanged + len(taken[other])):
                    if key not in taken[other] and len(new) < exchanged:
                        new.setdefault(key, x[other])
                taken[other] |= set(new)
                given.append((other, list(new.values()), float(good)))
        for other, found, good in given:
            if found:
                x, y = own[other]
                own[other] = (np.vstack([x, found]), np.concatenate([y, np.full(len(found), good)]))
    return ends[0], ends[1]


def surest_of(rows: DataFrame) -> Surest:
    """Named from all of ``rows``: one pass each time, and the asked number of rows to the driver."""

    def name(v: int, view: View, good: bool, most: int) -> list:
        odds = _linear(view, ("content", "page")[v])
        sure = rows.withColumn("sure", odds if good else -odds).where(F.col("sure") >= math.log(SURE / (1 - SURE)))
        found = sure.orderBy(F.col("sure").desc(), "text_hash", "doc_id").limit(most).collect()
        return [((r.doc_id, r.text_hash), (np.array(r.content), np.array(r.page))) for r in found]

    return name


def _linear(view: View, column: str) -> Column:
    terms = [
        F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(column)[at] - float(m)) / float(s))) * float(w)
        for at, (m, s, w) in enumerate(zip(view.middle, view.width, view.weights[:-1], strict=True))
    ]
    return float(view.scale) * (reduce(lambda a, b: a + b, terms) + float(view.weights[-1])) + float(view.shift)


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, training: int = TRAINING,
          seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, content_score, page_score and score (0 to 1, higher: better) of every document."""
    rows = common.stage(views(docs, pages), "quality-features")
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"))
    )
    # A bounded sample by seeded order: ``training`` rows reach the driver.
    learned = known.where(~common.held_out(5, 0)).withColumn("key", common.seeded(seed))
    chosen = common.stage(common.at_most(learned, training, "key", "doc_id"), "quality-labels")
    fitted = common.at_most(rows.join(F.broadcast(chosen), "doc_id"), training, "key", "text_hash").collect()
    part = np.array([int(r.key[-1], 16) < 12 for r in fitted], bool)
    y = np.array([float(r.quality) for r in fitted])
    good = known.agg(F.avg("quality")).head()[0]
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        share = F.lit(0.5 if good is None else float(good))
        return rows.select("doc_id", "text_hash", *[share.alias(n) for n in ("content_score", "page_score", "score")])
    spare = rows.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text_hash"])
    both = [np.array([r[k] for r in fitted]) for k in ("content", "page")]
    content, page = co_train(
        (both[0][part], both[1][part], y[part]), (both[0][~part], both[1][~part], y[~part]), surest_of(common.stage(spare, "quality-unlabelled"))
    )
    prior = float(np.log(y.mean() / (1 - y.mean())))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    a, b = _linear(content, "content"), _linear(page, "page")
    return rows.select("doc_id", "text_hash", a.alias("a"), b.alias("b")).select(
        "doc_id", "text_hash", chance(F.col("a")).alias("content_score"), chance(F.col("b")).alias("page_score"),
        chance(F.col("a") + F.col("b") - prior).alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    tables = [common.table(spark, folder, name) for name in ("documents", "labels", "pages")]
    return score(*tables).select(
        "doc_id", common.held_out(5, 0).alias("held_out"), "content_score", "page_score", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
