"""Ranges of documents whose ids are not evenly spread."""

import pytest
from llm import ngram_join, repeats, substring_dedup
from tests.llm import test_ngram_join, test_substring_dedup
from tests.llm.conftest import frame, words

FAR = [2**63 - 1, -(2**63), 10**12]


def uneven():
    """Most ids close together, a few far off, many null, one id with a third of the rows, one row many times."""
    rows = [(k, " ".join(words(k, 8, 10**6))) for k in range(600)] + [(k, " ".join(words(31, 30))) for k in FAR]
    rows += [(None, " ".join(words(2000 + k, 8, 10**6))) for k in range(400)]
    rows += [(77, " ".join(words(4000 + k, 8, 10**6))) for k in range(500)]
    return rows + [(5, "equal " * 30)] * 5000


def test_ranges_are_bounded_and_in_order(spark):
    rows = repeats.keyed(frame(spark, uneven()).repartition(4)).select("key", "doc_id", "text_hash", "copies").collect()
    ranges = {}
    for r in rows:
        ranges.setdefault(r.key, []).append((r.doc_id is not None, r.doc_id or 0, r.text_hash))
    assert max(map(len, ranges.values())) <= repeats.RANGE_DOCS
    assert sum(r.copies for r in rows) == len(uneven()) and len(rows) == len(set(uneven()))
    ends = [(min(v), max(v)) for _, v in sorted(ranges.items())]
    assert all(a[1] < b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


@pytest.mark.parametrize("ids", [FAR, [*FAR, *range(300)], [None, *FAR]])
def test_results_for_ids_far_apart(spark, ids):
    rows = [(k, " ".join(words(31, 30) + words(100 + at, 6))) for at, k in enumerate(ids)]
    assert test_substring_dedup.found(frame(spark, rows)) == test_substring_dedup.brute(rows)
    assert test_ngram_join.found(frame(spark, rows)) == test_ngram_join.brute(rows)


def test_every_equal_row_comes_back(spark):
    docs = frame(spark, uneven()).repartition(4)
    assert substring_dedup.without_repeats(docs).where("doc_id = 5").count() == 5001
    assert ngram_join.joined_sets(docs).where("doc_id = 5").count() == 5001
