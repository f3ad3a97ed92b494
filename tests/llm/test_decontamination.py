"""Automaton against a scan by hand."""

import hashlib
import re

import pytest
from llm import common, decontamination
from tests.llm.conftest import edge_texts, frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = WORD.findall(plain(text))
        for at in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[at : at + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        own, hit, ids = WORD.findall(plain(text)), set(), set()
        for k in sizes:
            for at in range(len(own) - k + 1):
                if (w := tuple(own[at : at + k])) in windows:
                    hit |= set(range(at, at + k))
                    ids |= windows[w]
        listed = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(own), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def benchmark_rows():
    b = words(2, 260)
    return [
        (1, " ".join(b[20:45])), (2, "Two, WORDS!"), (10, " ".join(words(3, 60)[10:20])), (3, None), (4, "..."), (5, "one"),
        (5, " ".join(b[5:15])), (6, "Ünï"), (7, " ".join(b[20:45])),
    ]


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_edges(spark, edges, size):
    items = spark.createDataFrame([(i, t, "mark") for i, t in benchmark_rows()], "item_id long, text string, window string")
    found = decontamination.digest(decontamination.contaminated(edges, items, automaton_bytes=size)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(edge_texts(), benchmark_rows())


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_spans_are_of_the_original(spark, size):
    text = "ß… Start: " + ", ".join(w.upper() for w in words(3, 30)) + " end!"
    items = spark.createDataFrame([(1, " ".join(words(3, 30)[4:24])), (2, " ".join(words(3, 30)[12:26]))], "item_id long, text string")
    row = decontamination.contaminated(frame(spark, [(1, text)]), items, automaton_bytes=size).head()
    ((a, b),) = row.spans
    assert WORD.findall(plain(text[a:b])) == words(3, 30)[4:26] and row.n_hit == 22


def test_empty(spark, edges, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(edges, items).where("n_hit > 0").count() == 0
    assert decontamination.contaminated(empty, items).count() == 0


def test_without_keeps_the_rest(spark, edges):
    gone = spark.createDataFrame([(4,), (None,)], "doc_id long").join(
        edges.select("doc_id", common.text_hash().alias("h")).alias("e"), "doc_id").select("doc_id", F_hash())
    left = common.without(edges, gone)
    assert left.columns == edges.columns and left.count() == edges.count() - 1


def F_hash():
    from pyspark.sql import functions as F

    return F.col("h").alias("text_hash")
