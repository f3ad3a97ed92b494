"""Repeated passages against a table of all windows."""

import hashlib
import random
import re

from llm import substring_dedup
from tests.llm.conftest import edge_texts, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Rows with distinct ids, null first."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = WORD.findall(text or "")
        gone = set()
        for at in range(len(own) - 19):
            window = tuple(own[at : at + 20])
            if window in seen:
                gone |= set(range(at, at + 20))
            seen.add(window)
        kept = " ".join(w for at, w in enumerate(own) if at not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def found(docs):
    rows = substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_edges(spark):
    rows, seen = [], set()
    for doc_id, text in edge_texts():
        if doc_id not in seen:
            rows.append((doc_id, text))
            seen.add(doc_id)
    assert found(frame(spark, rows).repartition(3)) == brute(rows)


def test_passages_anywhere(spark):
    draw, rows = random.Random(3), []
    passage = words(31, 45, 10**6)
    for doc_id in range(900):
        own = words(5000 + doc_id, draw.randrange(5, 60), 10**6)
        if doc_id % 3 == 0:
            at, size = draw.randrange(len(own)), draw.choice([19, 20, 21, 30, 45])
            start = draw.randrange(46 - size)
            own = own[:at] + passage[start : start + size] + own[at:]
        rows.append((doc_id * 7, " ".join(own)))
    draw.shuffle(rows)
    assert found(frame(spark, rows).repartition(5)) == brute(rows)


def test_equal_rows_get_equal_results(spark):
    text = " ".join(words(41, 50, 10**6))
    rows = found(frame(spark, [(1, text), (1, text), (2, text)]))
    assert [r[2] for r in rows] == [0, 0, 50]


def test_empty(empty):
    assert found(empty) == []
