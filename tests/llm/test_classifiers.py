"""Language, toxicity and quality on small corpora of known answers."""

import random
import zlib

import numpy as np
import pytest
from llm import common, language, quality, toxicity
from pyspark.sql import functions as F
from tests.llm.conftest import edge_texts, frame

SYLLABLES = {"en": "th er ing the on ea st".split(), "de": "ch sch ung ein ü ßt pf".split(), "fr": "eau é ou que è ai oi".split()}


def text_of(draw, lang, n, extra=()):
    own = ["".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)]
    for word in extra:
        own.insert(draw.randrange(len(own)), word)
    return " ".join(own).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    draw, rows, labels = random.Random(2), [], []
    for k in range(700):
        lang = draw.choice(list(SYLLABLES))
        toxic, good = int(draw.random() < 0.3), int(draw.random() < 0.6)
        extra = [draw.choice(["idiot", "blarg" + draw.choice(SYLLABLES[lang])]) for _ in range(4)] if toxic else []
        text = text_of(draw, lang, draw.randrange(30, 90), extra)
        if not good:
            text = "\n".join(" ".join(w + "###" for w in text.split()) for _ in range(3))
        rows.append((k, text, lang, "s", len(text)))
        labels.append((k, good, toxic, "mark"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, key string").cache()


def test_held_out_rule(spark):
    ids = [0, 7, 123456, -3]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.held_out(5, 0).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_languages(corpus):
    docs, _ = corpus
    docs = docs.withColumn("held_out", common.held_out(3, 1))
    found = language.predict(docs, language.fit(docs.where(~F.col("held_out"))))
    wrong = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count()
    assert wrong <= 2 and found.where("score < 0 or score > 1").count() == 0


def test_languages_at_the_edges(spark, corpus, edges, empty):
    docs, _ = corpus
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(edges.withColumn("held_out", F.lit(True)), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (4, 5, 6, 18, 21)) and got[16].lang_pred != "und"
    assert language.predict(empty.withColumn("held_out", F.lit(True)), model).count() == 0
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs.withColumn("held_out", F.lit(True)), nothing).collect()} == {"und"}


def area(rows):
    """Share of (1, 0) pairs that the score puts right."""
    ones, zeros = ([s for y, s in rows if y == v] for v in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity(corpus, edges, empty):
    docs, labels = corpus
    found = toxicity.score(docs, labels)
    rows = found.where(common.held_out(5, 0)).join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    assert area([(r.toxic, r.score) for r in rows]) > 0.95
    assert sum(r.toxic == r.predicted for r in rows) > 0.9 * len(rows)
    assert toxicity.score(empty, labels).count() == 0
    # Without labels of both classes the score is the share of toxic ones.
    none = labels.where("toxic = 0").select("doc_id", "toxic")
    assert {r.score for r in toxicity.score(edges, none).collect()} == {0.0}
    assert toxicity.score(edges, none.limit(0)).count() == len(edge_texts())


def test_toxic_features():
    codes = toxicity._Words({"blar-": 2.5})
    value = dict(zip(toxicity.FEATURES, toxicity.features_of(b"YOU blargous 1d1ot!! soooo you?", codes), strict=True))
    assert value["insult_density"] == pytest.approx(1 / 5) and value["lexicon_hits"] == pytest.approx(1.0986, abs=1e-3)
    assert value["near_second"] == 1 and value["lexicon_top"] == 2.5 and value["obfuscated"] > 0 and value["stretched"] > 0
    assert all(v == 0 for v in toxicity.features_of(None, codes))


def test_quality(corpus, edges, empty, spark):
    docs, labels = corpus
    pages = spark.createDataFrame([(3, "https://a.b/c/d?e", "<p>"), (3, None, None), (None, "x", "y")], "page_id long, url string, html string")
    found = quality.score(docs, labels, pages)
    rows = found.where(common.held_out(5, 0)).join(labels, "doc_id").select("quality", "score", "content_score", "page_score").collect()
    for name in ("score", "content_score", "page_score"):
        assert area([(r.quality, r[name]) for r in rows]) > 0.95
    assert quality.score(empty, labels, pages).count() == 0
    assert quality.score(edges, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality.score(edges, labels).count() == len(edge_texts())


def plain_surest(keys, pool):
    """Every document looked at, on the driver."""

    def name(v, view, good, most):
        odds = view.odds(pool[v]) if good else -view.odds(pool[v])
        order = sorted((k for k in range(len(odds)) if odds[k] >= np.log(0.95 / 0.05)), key=lambda k: (-odds[k], keys[k]))
        return [(keys[k], (pool[0][k], pool[1][k])) for k in order[:most]]

    return name


def test_exchange_looks_at_all_documents(spark, corpus):
    """Spark's surest documents are those of a plain look at every row, round by round, repeated rows once."""
    docs, labels = corpus
    rows = quality.views(docs).cache()
    held = sorted(rows.collect(), key=lambda r: (r.text_hash, r.doc_id))
    truth = {r.doc_id: float(r.quality) for r in labels.collect()}
    known, check, pool = held[:60], held[60:160], held[160:]

    def both(part):
        return tuple(np.array([r[n] for r in part]) for n in ("content", "page"))

    y = [np.array([truth[r.doc_id] for r in part]) for part in (known, check)]
    spare = spark.createDataFrame(pool + pool[:50], rows.schema).dropDuplicates(["doc_id", "text_hash"]).repartition(5)
    keys = [(r.doc_id, r.text_hash) for r in pool]
    pairs = [
        quality.co_train((*both(known), y[0]), (*both(check), y[1]), surest, exchanged=7)
        for surest in (quality.surest_of(spare), plain_surest([(h, d) for d, h in keys], both(pool)))
    ]
    for ours, plain in zip(*pairs, strict=True):
        assert np.allclose(ours.weights, plain.weights, atol=1e-7) and abs(ours.shift - plain.shift) < 1e-7


def test_views_teach_each_other():
    draw = np.random.default_rng(3)
    y = (draw.random(3000) < 0.5).astype(float)
    a, b = (np.stack([y * 4 + draw.normal(size=3000), draw.normal(size=3000)], 1) for _ in (0, 1))
    few, check, pool = slice(0, 14), slice(14, 200), slice(200, 3000)
    surest = plain_surest(range(2800), (a[pool], b[pool]))
    ends = [quality.co_train((a[few], b[few], y[few]), (a[check], b[check], y[check]), surest, rounds=r) for r in (0, 3)]
    right = [np.mean((e[1].odds(b[pool]) > 0) == (y[pool] > 0)) for e in ends]
    assert right[1] >= right[0] and right[1] > 0.95
