"""Targets, flow and selection."""

import random

import pytest
from llm import mixing
from pyspark.sql import functions as F
from tests.llm.conftest import edge_texts, frame, words


def test_targets_reshare_what_exceeds():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 0}
    got = mixing.targets(sizes, mixing.weigh(list(sizes)), 1.5 * 1110)
    assert got["a"] == 200 and got["b"] == 20 and got[None] == 0
    assert got["c"] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.weigh(["b", None, "é", "a", "z"]) == {"a": 5, "b": 2, "z": 1, "é": 5, None: 2}
    assert mixing.targets({}, {}, 0) == {} and mixing.targets({"a": 0}, {"a": 5}, 0.0) == {"a": 0.0}


def cost_and_words(flow, patterns):
    used = {p: sum(w for (q, _), w in flow.items() if q == p) for p in patterns}
    return sum(max(0, used[p] - size) for p, size in patterns.items()), sum(used.values())


def test_flow_repeats_as_little_as_it_can():
    # "ab" can serve both; "a" alone is small, so "b" must leave "ab" to it.
    patterns = {("a",): 10, ("b",): 100, ("a", "b"): 50}
    flow = mixing.route(patterns, {"a": 60, "b": 100})
    assert flow[("a",), "a"] == 10 and flow[("a", "b"), "a"] == 50 and flow[("b",), "b"] == 100
    assert cost_and_words(flow, patterns) == (0, 160)


def test_flow_against_all_small_ones():
    draw = random.Random(5)
    for _ in range(60):
        patterns = {("a",): draw.randrange(4), ("b",): draw.randrange(4), ("a", "b"): draw.randrange(4)}
        quotas = {"a": draw.randrange(9), "b": draw.randrange(9)}
        best = None
        for to_a in range(2 * patterns["a", "b"] + 1):
            for to_b in range(2 * patterns["a", "b"] + 1 - to_a):
                a = min(quotas["a"] - to_a, 2 * patterns[("a",)])
                b = min(quotas["b"] - to_b, 2 * patterns[("b",)])
                if a < 0 or b < 0:
                    continue
                cost = sum(max(0, w - s) for w, s in ((a, patterns[("a",)]), (b, patterns[("b",)]), (to_a + to_b, patterns["a", "b"])))
                key = (-(a + b + to_a + to_b), cost)
                best = key if best is None or key < best else best
        cost, total = cost_and_words(mixing.route(patterns, quotas), patterns)
        assert (-total, cost) == best


def test_mix_meets_targets(spark, edges):
    draw = random.Random(9)
    rows = [(k, " ".join(words(k, draw.randrange(1, 200)))) for k in range(600)]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))))
    got = mixing.mix(mixing.by_source(docs)).collect()
    assert len(got) == 600
    by = {}
    for r in got:
        own = by.setdefault(r.members[0], [0, r.routes[0].target])
        own[0] += r.size * r.times
        assert r.times <= 2 and r.size == len(dict(rows)[r.doc_id].split())
    assert len(by) == 7 + 0 if None not in by else len(by) == 8
    for taken, target in by.values():
        assert abs(taken - target) <= 30
    again = {(r.doc_id, r.times) for r in mixing.mix(mixing.by_source(docs.repartition(5))).collect()}
    assert again == {(r.doc_id, r.times) for r in got}


def test_overlapping_sources(spark):
    rows = [(k, " ".join(words(k, 10)), ["a"] if k < 10 else ["a", "b"] if k < 60 else ["b", None]) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    got = mixing.mix(docs).collect()
    assert sum(r.times for r in got) * 10 == pytest.approx(1500, abs=30)
    assert mixing.mix(docs.select("doc_id", "text", F.lit(None).cast("array<string>").alias("members"))).where("times > 0").count() == 0


def test_edges(edges, empty):
    got = mixing.mix(mixing.by_source(edges)).collect()
    assert len(got) == len(edge_texts()) and all(r.size * r.times == 0 for r in got if r.doc_id in (4, 5, 6))
    taken = mixing.mixed_documents(edges)
    assert taken.columns == [*edges.columns, "copy"]
    assert taken.count() == sum(r.times for r in got if r.size or r.times)
    assert mixing.mix(mixing.by_source(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_empty_documents_of_a_capped_source(spark):
    rows = [(k, "") for k in range(30)] + [(30, "one two three"), (31, "four five")] + [(k, " ".join(words(k, 50))) for k in range(40, 60)]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") < 40, "a").otherwise("b"))
    copies = {}
    for r in mixing.mixed_documents(docs).collect():
        copies.setdefault(r.doc_id, []).append(r["copy"])
    assert sorted(copies[30]) == sorted(copies[31]) == [1, 2]
    assert max(map(len, copies.values())) == mixing.USES
