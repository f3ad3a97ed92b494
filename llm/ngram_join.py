"""Jaccard join on word n-grams with vertical partitioning.

A document is the set of its 5-word shingles. All shingles have one global order,
from rare to frequent and then by hash; shingles of a single document count as
rarest. The order serves twice:

- two sets that are similar enough share a shingle among the first few of each
  (the prefix), so only documents with such a shingle in common are compared;
- it is cut into *fragments*. A pair's common shingles are counted fragment by
  fragment on short segments, and the partial counts are summed per pair.

Equal sets are one class; links are sought between classes. Within all classes
that share a prefix shingle, first the members of one size range are compared
with one of them; links found join them to components. Then exactly the pairs
that still lie in different components are compared, so a group of thousands of
near copies takes a link for each member and no link between texts is lost.

Defined results: null and wordless texts have empty sets and are alone; fewer
than five words are one shingle; rows with one id count together for
``component_id``, null ids do not give one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, repeats
from .components import components, few

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: The order is cut at every level of frequency and into so many hash ranges each.
CUTS = 4
STEP = 1.03

_SETS = "doc_id long, text_hash long, copies long, n long, cls binary, shared long, tokens binary, levels binary"


def shingles(text: bytes | None, known: common.WordHashes) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    hashes = known.of((text or b"").translate(common.LOWER).split())
    if not len(hashes):
        return hashes
    return np.unique(common.windows(hashes, min(WORDS, len(hashes))))


def _needed(n: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-PERCENT * n // 100)


def _class(tokens: np.ndarray) -> bytes:
    stirred = common.mix(tokens)
    a = stirred.sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(common.mix(stirred + np.uint64(0x9E3779B97F4A7C15))) + np.uint64(len(tokens))
    return a.astype(">u8").tobytes() + b.astype(">u8").tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Every document (equal rows once, with their copies), its set's size and class; shared shingles, in the global order,
    where enough of them are shared for any link at all."""
    how = repeats.plan(docs)
    rows = repeats.keyed(docs)

    def items(text: bytes | None, known: common.WordHashes = common.WordHashes()) -> tuple[np.ndarray, None]:
        return shingles(text, known), None

    def build(given_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.WordHashes()
        names = [c.split()[0] for c in _SETS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for _, given, documents in repeats.ranges_of(given_rows):
            answers = np.sort(np.frombuffer(b"".join(given), np.uint64))
            shorts = answers >> np.uint64(4)
            out: list[list] = [[] for _ in names]
            for doc_id, text_hash, copies, text in documents:
                own = shingles(text, known)
                n = len(own)
                at = repeats.among(how.short(own), shorts)
                held = at >= 0
                shared, tokens, levels = int(held.sum()), None, None
                if n and shared >= _needed(n):
                    level = (answers[at[held]] & np.uint64(15)).astype(np.uint8)
                    order = np.lexsort((own[held], level))
                    tokens, levels = own[held][order].tobytes(), level[order].tobytes()
                value = (doc_id, text_hash, copies, n, _class(own) if n else None, shared, tokens, levels)
                for column, v in zip(out, value, strict=True):
                    column.append(v)
            yield repeats.batch_of(list(zip(names, out, kinds, strict=True)))

    answers = common.stage(repeats.repeated(rows, how, items), "shared-shingles", free=True)
    return common.stage(repeats.met(rows, answers).mapInArrow(build, _SETS), "shingle-sets", free=True)


def _prefixes(classes: DataFrame) -> DataFrame:
    """(token, place, cls, n, size): the shared shingles among each class's first ones."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            token, place, cls, n, size = [], [], [], [], []
            for c, total, shared, data in zip(*(common.blobs(batch, k) for k in ("cls", "n", "shared", "tokens")), strict=True):
                count = shared - _needed(total) + 1
                token.append(np.frombuffer(data, np.int64, count))
                place.append(np.arange(total - shared, total - shared + count))
                cls += [c] * count
                n.append(np.full(count, total))
                size.append(np.full(count, int(math.log(total) / math.log(100 / PERCENT))))
            joined = lambda parts: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
            yield repeats.batch_of([
                ("token", joined(token), pa.int64()), ("place", joined(place), pa.int64()), ("cls", cls, pa.binary()),
                ("n", joined(n), pa.int64()), ("size", joined(size), pa.int64()),
            ])

    return classes.select("cls", "n", "shared", "tokens").mapInArrow(
        cut, "token long, place long, cls binary, n long, size long"
    )


def _segments(classes: DataFrame) -> DataFrame:
    """(cls, fragment, tokens): each class cut by the fragments of the global order."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cls, fragment, tokens = [], [], []
            for c, data, level in zip(*(common.blobs(batch, k) for k in ("cls", "tokens", "levels")), strict=True):
                own = np.frombuffer(data, np.uint64)
                number = np.frombuffer(level, np.uint8).astype(np.int64) * CUTS + (own >> np.uint64(62)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(own)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if b > a:
                        cls.append(c)
                        fragment.append(int(number[a]))
                        tokens.append(own[a:b].view(np.int64))
            yield repeats.batch_of([
                ("cls", cls, pa.binary()), ("fragment", fragment, pa.int32()), ("tokens", tokens, pa.list_(pa.int64())),
            ])

    return classes.select("cls", "tokens", "levels").mapInArrow(cut, "cls binary, fragment int, tokens array<long>")


def _links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (x, y, nx, ny) that are similar: partial overlaps per fragment, summed per pair."""
    own = _segments(classes)
    left = own.select(F.col("cls").alias("x"), "fragment", F.col("tokens").alias("tx"))
    right = own.select(F.col("cls").alias("y"), "fragment", F.col("tokens").alias("ty"))
    both = F.sum("partial")
    return (
        pairs.join(right, "y").join(left, ["x", "fragment"])
        .select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).cast("long").alias("partial"))
        .groupBy("x", "y", "nx", "ny").agg(both.alias("overlap"))
        .where((100 + PERCENT) * F.col("overlap") >= PERCENT * (F.col("nx") + F.col("ny")))
        .select("x", "y")
    )


def _near(a: str, b: str) -> F.Column:
    """Whether the sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _enough_left() -> F.Column:
    """Whether the shingles from a common first one on (at px and py) suffice for a link."""
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    return (100 + PERCENT) * most >= PERCENT * (F.col("nx") + F.col("ny"))


def class_links(sets: DataFrame) -> DataFrame:
    """(node, component) of all classes that link with another, components named by a class."""
    classes = common.stage(
        sets.where(F.col("tokens").isNotNull()).select("cls", "n", "shared", "tokens", "levels").dropDuplicates(["cls"]),
        "classes",
        free=True,
    )
    prefixes = common.stage(_prefixes(classes), "prefixes")
    # One member of each size range stands for those that share a shingle with it: the
    # one with the fewest shingles before it, as copies differ least from an original.
    pivots = prefixes.groupBy("token", "size").agg(
        F.min(F.struct("place", "cls", "n")).alias("pivot"), F.count("*").alias("k")
    ).where("k > 1")
    stars = (
        prefixes.join(pivots, ["token", "size"])
        .select(
            F.col("pivot.cls").alias("x"), F.col("cls").alias("y"), F.col("pivot.n").alias("nx"), F.col("n").alias("ny"),
            F.col("pivot.place").alias("px"), F.col("place").alias("py"),
        )
        .where((F.col("x") != F.col("y")) & _near("nx", "ny") & _enough_left())
        .select("x", "y", "nx", "ny").distinct()
    )
    stars = common.stage(stars, "pairs", free=True)
    found = common.stage(few(_links(stars, classes), stars.count()), "class-links", free=True)
    joined = common.stage(components(found), "star-components")
    # Pairs with a common shingle that are still apart. If x is not larger than y, their
    # first common shingle stands early enough in x for an overlap of 8/9 of x.
    rows = prefixes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select(
        "token", "place", "cls", "n", F.coalesce("component", "cls").alias("component")
    )
    early = (100 + PERCENT) * (F.col("n") - F.col("place")) >= 2 * PERCENT * F.col("n")
    rows = rows.withColumn("early", early)
    apart = rows.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("early").alias("any")
    ).where("lo <> hi and any")
    rows = common.stage(rows.join(apart.select("token"), "token", "left_semi"), "apart", free=True)
    # A place bounds the sizes of possible partners; sizes meet in steps of STEP.
    step = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    left = F.col("n") - F.col("place")
    most = F.least(F.col("n").cast("double"), left * ((100 + PERCENT) / PERCENT) - F.col("n"))
    xs = rows.where("early").select(
        "token", F.col("component").alias("cx"), F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"),
        step(F.col("n")).alias("size"),
    )
    ys = rows.where(most >= F.col("n") * (PERCENT / 100) - 1).select(
        "token", F.col("component").alias("cy"), F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"),
        F.explode(F.sequence(step(F.greatest(F.lit(1.0), F.col("n") * (PERCENT / 100) - 1)), step(most + 1))).alias("size"),
    )
    # Components meet first, so members of one component never do.
    meet = xs.select("token", "size", "cx").distinct().join(ys.select("token", "size", "cy").distinct(), ["token", "size"])
    pairs = (
        meet.where("cx <> cy").join(xs, ["token", "size", "cx"]).join(ys, ["token", "size", "cy"])
        .where(((F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))) & _near("nx", "ny") & _enough_left())
        .select("x", "y", "nx", "ny").distinct()
    )
    pairs = common.stage(pairs, "pairs")
    more = common.stage(few(_links(pairs, classes), pairs.count()), "class-links")
    if more.isEmpty():
        return joined
    whole = joined.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more)
    return common.stage(components(whole), "components")


def joined_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least id among all that a document can reach
    by links) and component (names the group; null for an empty set, which is alone)."""
    sets = shingle_sets(docs)
    links = class_links(sets)
    least = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(links.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    named = common.stage(named, "class-names")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(ids, "component").select("cls", "component", "component_id")
    return repeats.copied(sets.join(of_class, "cls", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "component", "copies",
    ))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of least id (then hash); rows equal in both once.

    Documents with empty sets are no copies of each other and all stay.
    """
    rows = common.stage(joined_sets(docs), "near-copies")
    grouped = rows.where(F.col("component").isNotNull())
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    stays = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.text_hash") == F.col("text_hash"))
    left = common.without(docs, grouped.join(first, "component").where(~stays))
    # What is left twice is equal in id and text.
    twice = grouped.groupBy("doc_id", "text_hash").count().where("count > 1")
    twice = common.stage(twice, "equal-rows")
    if twice.isEmpty():
        return left
    again = (
        common.rows_by_key(left).alias("d").join(common.keys(twice).alias("t"), common.same_key("d", "t"), "left_semi")
        .dropDuplicates(["id", "hash"]).select("row.*")
    )
    return common.without(left, twice).unionByName(again)


SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE {100 + PERCENT} * k >= {PERCENT} * (nx.n + ny.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM r JOIN e ON b = x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return joined_sets(common.table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
