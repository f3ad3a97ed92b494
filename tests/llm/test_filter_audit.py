"""Audit of filters against every order played through document by document."""

import random
import re
from itertools import permutations

import pytest
from llm import filter_audit as audit
from tests.llm.conftest import frame

LABELS = "doc_id long, quality int, toxic int, text string, share string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def played(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    bad = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        failed = {f for f, no in fails(text or "").items() if no}
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
            failed.add("E")
        docs.append((lang or "", frozenset(failed), i in good, i in bad))
    found, totals = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [d for d in left if name in d[1]]
                found[part, "".join(order), step] = [
                    len(left) - len(here), len(here), sum(name in d[1] for d in gone),
                    sum(d[0] == part and d[1] == {name} for d in docs), sum(d[2] for d in here), sum(d[3] for d in here)]
                totals[part, name] = totals.get((part, name), 0) + len(here)
                gone, left = gone + here, [d for d in left if name not in d[1]]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def got(docs, labels):
    rows = audit.audit(docs, labels).collect()
    table = {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows
    }
    assert len(table) == len(rows)
    return table


def label_frame(spark, labels):
    return spark.createDataFrame([(*row, "mark", "mark") for row in labels], LABELS)


def test_edges(spark, edges, empty):
    rows = [(r.doc_id, r.text, r.lang) for r in edges.collect()]
    labels = [(0, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (3, 0, 1), (4, 1, 1), (17, 1, 1), (22, 1, 0), (23, 0, 0), (None, 1, 1), (999, 1, 1)]
    assert got(edges, label_frame(spark, labels)) == played(rows, labels)
    assert got(edges, label_frame(spark, [])) == played(rows, [])
    assert got(empty, label_frame(spark, labels)) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_and_mixed_failures(spark, seed):
    draw = random.Random(seed)
    stock = [
        " ".join(draw.choice(["ab", "Cd", "EF", "x#", "ghij", "Kl"] if n % 2 else [f"w{k}" for k in range(400)]) for _ in range(draw.choice([150, 199, 200, 260])))
        for n in range(12)
    ]
    rows = [(draw.choice([None, *range(300)]), draw.choice([*stock, None, "", stock[0], stock[0]])) for _ in range(400)]
    docs = frame(spark, rows).repartition(7)
    labels = [(n, draw.choice([0, 1, None]), draw.choice([0, 1])) for n in range(0, 300, 2)]
    full = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert got(docs, label_frame(spark, labels)) == played(full, labels)


def test_labels_are_not_broadcast(spark, tmp_path):
    """The driver holds no labels, however small their files: a broadcast is judged by those and is many times larger."""
    docs, labels = str(tmp_path / "documents"), str(tmp_path / "labels")
    frame(spark, [(n, f"text {n % 700}") for n in range(1000)]).write.parquet(docs)
    label_frame(spark, [(n, n % 2, int(n % 3 == 0)) for n in range(0, 1000, 2)]).selectExpr("doc_id", "quality", "toxic").write.parquet(labels)
    counts = audit.outcomes(spark.read.parquet(docs), spark.read.parquet(labels))
    plan = counts._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert sum(r.docs for r in counts.collect()) == 1000
    assert plan.toString().startswith("AdaptiveSparkPlan isFinalPlan=true") and "Broadcast" not in plan.toString()


def test_paths():
    """Every order passes one state per step: reached times left sums to all orders on each level."""
    for n, orders in ((1, 1), (3, 6), (5, 120)):
        forward, backward = audit.orders_through(n)
        assert forward[-1] == backward[0] == orders
        for level in range(n + 1):
            assert sum(f * b for state, (f, b) in enumerate(zip(forward, backward, strict=True)) if state.bit_count() == level) == orders
