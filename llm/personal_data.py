"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns: the four base kinds, whose valid matches
always stay, and looser forms of each kind (bracketed addresses, national phone
numbers, dotted cards, long IP addresses). Labelers (pattern, gazetteer,
context, shape) vote for, against or not at all. Candidates are counted by kind
and votes over all documents; expectation-maximisation on those counts gives each
labeler's reliability, and a logistic span classifier is fitted to the resulting
posteriors. Loose candidates that it accepts and that touch no base span are
added.

Votes are counted by the cluster: 4 kinds x 2 x 3^4 votes are at most 648 rows,
whatever the corpus. Only they reach the driver, where both fits are plain
arithmetic. Patterns match without backtracking into earlier starts, so very
long runs of digits or letters take linear time.

Defined results: null counts as empty; texts without spans have empty lists;
rows equal in id and text get equal results each; with no candidates at all the
classifier keeps its start, a majority of votes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

# Kinds in order.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]++"
#: Base patterns. A match can only begin where no earlier start would have
#: matched: at the beginning of a run, or where the match before ended (\\G).
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?[\[({{](?:at|AT|@)[\])}}]\x20?{_LABEL}"
    r"(?:\x20?(?:[\[({](?:dot|DOT|\.)[\])}]|\.)\x20?[A-Za-z0-9]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){2,3}(?![0-9.])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|00[1-9][0-9]{0,2}[\x20/-]|0[0-9]{1,4}[\x20/-]|[2-9][0-9]{2}[-.])"
    r"[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9])",
}
# Gazetteers and words of context, before the span or just after it.
TOP_DOMAINS = "com org net edu gov info io eu de fr es uk ch at it nl be ca us mx ar br au jp cn in"
CARD_BEGINNINGS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30[0-5])"
CALLING_CODES = r"^(?:00|\+)?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_IP = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write|schreib\w*|to|from)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|from|ping|client|dirección)\b",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|handy|telefon|téléphone|teléfono|whatsapp|sms)\b",
}
AGAINST = r"(?i)\b(?:version|release|v\.?|licen[sc]e|isbn|order|invoice|serial|section|§|id|no|nr)[\x20.:#-]*$"

LOOSELY = "loosely "
LABELERS = ["pattern", "gazetteer", "context", "shape"]
#: Votes as pseudo-observations: a labeler starts right in 8 of 10 cases.
_PRIOR, _ROUNDS = 10.0, 60
_CONTEXT = 40


def _octets() -> str:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return rf"^{part}\.{part}\.{part}\.{part}$"


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the check sum."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for place in range(19):
        digit = F.substring(padded, 19 - place, 1).cast("int")
        twice = digit * 2
        total = total + (digit if place % 2 == 0 else F.when(twice > 9, twice - 9).otherwise(twice))
    return F.length(digits).between(12, 19) & (total % 10 == 0)


def candidates(docs: DataFrame) -> DataFrame:
    """Matches of all patterns with code-point offsets, surroundings and validity.

    ``docs`` has doc_id, text_hash and text. Text never leaves its row: only
    matches, lengths of what lies between and some context do. Offsets are
    running sums within a document; the one shuffle is by document. Loose matches
    that touch a base one are left out.
    """
    text = F.col("text")
    patterns = [(kind, True, BASE[kind]) for kind in KINDS] + [(kind, False, LOOSE[kind]) for kind in KINDS]
    gaps = lambda pattern: F.transform(
        F.split(text, pattern),
        lambda p: F.struct(
            F.length(p).alias("size"), F.right(p, F.lit(_CONTEXT)).alias("tail"), F.left(p, F.lit(12)).alias("head")
        ),
    )
    hits = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.when(text.rlike(pattern), gaps(pattern)).alias("gaps"),
                F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("found"),
            )
            for kind, base, pattern in patterns
        ]
    )
    rows = (
        docs.where(text.rlike("[0-9@]") | text.rlike(r"[\[({](?:at|AT)[\])}]"))
        .select("doc_id", "text_hash", F.explode(hits).alias("hit"))
        .where(F.col("hit.found").isNotNull())
        .select(
            "doc_id", "text_hash", "hit.kind", "hit.base",
            F.posexplode(
                F.transform(
                    F.col("hit.found"),
                    lambda found, at: F.struct(
                        found.alias("found"), F.get("hit.gaps", at)["size"].alias("gap"),
                        F.get("hit.gaps", at)["tail"].alias("before"), F.get("hit.gaps", at + 1)["head"].alias("after"),
                    ),
                )
            ).alias("place", "match"),
        )
        .select("doc_id", "text_hash", "kind", "base", "place", "match.*")
        .withColumn("size", F.length("found"))
        .repartition("doc_id", "text_hash")
        .dropDuplicates(["doc_id", "text_hash", "kind", "base", "place"])
    )
    upto = W.partitionBy("doc_id", "text_hash", "kind", "base").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    digits = F.regexp_replace("found", "[^0-9]", "")
    valid = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", ~F.col("base") | F.col("found").rlike(_octets()))
        .when(F.col("kind") == "card", _luhn(digits))
        .otherwise(F.length(digits).between(9, 15))
    )
    found = (
        rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("digits", digits)
        .where(valid).drop("place", "gap")
    )
    own = W.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("base"), "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(1, W.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return found.withColumn("apart", F.col("base") | apart).where("apart").drop("apart")


def votes(found: DataFrame) -> DataFrame:
    """The labelers' votes: 1 for, -1 against, 0 none."""
    kind, text, digits = F.col("kind"), F.col("found"), F.col("digits")
    domain = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))
    known = (
        F.when(kind == "email", F.when(domain.isin(TOP_DOMAINS.split()), 1).otherwise(-1))
        .when(kind == "ip", F.when(text.rlike(RESERVED_IP), -1).otherwise(1))
        .when(kind == "card", F.when(digits.rlike(CARD_BEGINNINGS), 1).otherwise(-1))
        .when(F.col("base"), F.when(text.rlike(CALLING_CODES), 1).otherwise(-1))
        .otherwise(0)
    )
    cue = reduce(lambda a, k: a.when(kind == k, F.col("before").rlike(FOR[k])), KINDS[1:], F.when(kind == KINDS[0], F.col("before").rlike(FOR[KINDS[0]])))
    context = F.when(F.col("before").rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    embedded = F.col("before").rlike(r"[\p{L}0-9_]$") | F.col("after").rlike(r"^[\p{L}0-9_@]")
    good = (
        F.when(kind == "email", ~text.rlike(r"\.\.|^\.|\.@"))
        .when(kind == "ip", ~F.col("after").rlike(r"^\.[0-9]") & ~F.col("before").rlike(r"[0-9]\.$"))
        .when(kind == "card", F.length(digits).isin(13, 15, 16, 19))
        .otherwise(F.length(digits).between(10, 13))
    )
    shape = F.when(embedded, -1).when(good, 1).otherwise(0)
    return (
        found.withColumn("pattern", F.when(F.col("base"), 1).otherwise(0)).withColumn("gazetteer", known)
        .withColumn("context", context).withColumn("shape", shape)
    )


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict, list[dict[int, float]], dict]:
    """EM over (kind, votes, n), base and loose kinds apart: share of true spans per kind, each labeler's chance
    of a vote for, and the posterior of every (kind, votes)."""
    names = sorted({kind for kind, _, _ in counts})
    share = dict.fromkeys(names, 0.5)
    # Chance of a vote for, given a true (1) or a false (0) span; no vote tells nothing.
    chance = [{1: 0.8, 0: 0.2} for _ in LABELERS]
    posterior: dict = {}
    for _ in range(_ROUNDS):
        for kind, vote, _n in counts:
            odds = math.log(share[kind] / (1 - share[kind]))
            for c, v in zip(chance, vote, strict=True):
                if v:
                    odds += math.log(c[1] / c[0]) if v > 0 else math.log((1 - c[1]) / (1 - c[0]))
            posterior[kind, vote] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in names:
            own = [(posterior[k, v], n) for k, v, n in counts if k == kind]
            share[kind] = (sum(p * n for p, n in own) + _PRIOR / 2) / (sum(n for _, n in own) + _PRIOR)
        for at, c in enumerate(chance):
            for y in (0, 1):
                given = [(vote[at], n * (posterior[k, vote] if y else 1 - posterior[k, vote])) for k, vote, n in counts]
                up = sum(n for v, n in given if v > 0) + _PRIOR * (0.8 if y else 0.2)
                c[y] = up / (sum(n for v, n in given if v) + _PRIOR)
    return share, chance, posterior


def span_classifier(counts: list[tuple[str, tuple[int, ...], int]], posterior: dict) -> list[float]:
    """Weights of a logistic model (offset, votes, kinds) fitted to the posteriors."""
    inputs = lambda kind, vote: [1.0, *map(float, vote), *(float(kind.removeprefix(LOOSELY) == k) for k in KINDS)]
    # A span needs more votes for than against; kinds and offset are held to that more strongly.
    start = [-0.5, *[1.0] * len(LABELERS), *[0.0] * len(KINDS)]
    hold = [0.2, *[0.01] * len(LABELERS), *[0.2] * len(KINDS)]
    total = sum(n for _, _, n in counts)
    weights = list(start)
    for _ in range(400 if total else 0):
        slope = [0.0] * len(weights)
        for kind, vote, n in counts:
            x = inputs(kind, vote)
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for at, value in enumerate(x):
                slope[at] += n / total * (posterior[kind, vote] - guess) * value
        weights = [w + 0.5 * (s - h * (w - o)) for w, s, h, o in zip(weights, slope, hold, start, strict=True)]
    return weights


def _span() -> Column:
    order = reduce(lambda a, k: a.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    return F.struct("start", order.alias("rank"), "end", "kind", "base", F.col("chance"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and sorted spans (start, rank, end, kind, base, chance) of documents that have any."""
    found = common.stage(votes(candidates(docs)).drop("before", "after", "digits", "found", "size"), "personal-candidates")
    counted = found.groupBy("kind", "base", *LABELERS).agg(F.count("*").alias("n"))
    counts: dict[tuple, int] = {}
    for r in counted.collect():
        at = (r.kind if r.base else LOOSELY + r.kind, tuple(r[name] for name in LABELERS))
        counts[at] = counts.get(at, 0) + r.n
    table = [(kind, vote, n) for (kind, vote), n in sorted(counts.items())]
    weights = span_classifier(table, reliabilities(table)[2])
    inputs = [F.lit(1.0), *[F.col(n).cast("double") for n in LABELERS], *[(F.col("kind") == k).cast("double") for k in KINDS]]
    chance = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [F.lit(w) * x for w, x in zip(weights, inputs, strict=True)])))
    return (
        found.withColumn("chance", chance).where(F.col("base") | (F.col("chance") >= 0.5))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(_span())).alias("spans"))
    )


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("text_hash"), text.alias("text"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (code points, end exclusive; empty where none) of every document."""
    rows, found = keyed(docs), spans(keyed(docs))
    joined = rows.select("doc_id", "text_hash").alias("d").join(
        found.alias("f"),
        F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left",
    )
    empty = F.array().cast(found.schema["spans"].dataType)
    return joined.select("d.doc_id", F.coalesce("spans", empty).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents, each span's text replaced by its kind in brackets; ``n_chars`` follows.

    Texts without a candidate sign pass by; the others meet their spans by id and
    hash. A span starts no earlier than the furthest end before it, so of one that
    lies within another only the mark is added.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = spans(keyed(docs)).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    signs = F.coalesce(text.rlike(r"[0-9@]|[\[({](?:at|AT)[\])}]"), F.lit(False))
    met = common.rows_by_key(docs.where(signs)).alias("d").join(found.alias("f"), common.same_key("d", "f"), "left")
    # Spans in order; each piece is the text since the furthest end before and a mark.
    spans_, own = F.col("f.spans"), F.col("row.text").cast("string")
    reached = F.aggregate(
        spans_, F.array(F.lit(0).cast("long")), lambda ends, s: F.concat(ends, F.array(F.greatest(F.element_at(ends, -1), s["end"])))
    )
    piece = lambda s, end: F.concat(
        F.when(s["start"] > end, F.substring(own, end + 1, s["start"] - end)).otherwise(F.lit("")),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    )
    pieces = F.zip_with(spans_, F.slice(reached, 1, F.size(spans_)), piece)
    rest = F.substring(own, F.array_max(F.transform(spans_, lambda s: s["end"])) + 1, F.lit(2**31 - 1))
    new = F.when(F.size(spans_) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(own)
    done = met.select("row", new.alias("new"))
    kinds = dict(docs.dtypes)
    columns = [
        F.col("new").alias(name) if name == "text"
        else F.length("new").cast(kinds[name]).alias(name) if name == "n_chars"
        else F.col(f"row.`{name}`") for name in docs.columns
    ]
    return docs.where(~signs).unionByName(done.select(*columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(common.table(spark, folder, "documents"))
    listed = lambda spans_: F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
