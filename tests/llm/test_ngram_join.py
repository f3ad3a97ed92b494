"""Jaccard join against all pairs of sets."""

import itertools
import random
import re

from llm import components, ngram_join
from tests.llm.conftest import edge_texts, frame, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    own = WORD.findall((text or "").encode().lower())
    if not own:
        return frozenset()
    k = min(5, len(own))
    return frozenset(tuple(own[at : at + k]) for at in range(len(own) - k + 1))


def brute(rows):
    """(doc_id, size, component id) per row; rows with one id count together by class."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for at, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(at)] = min(least.get(find(at), doc_id), doc_id)
    return sorted(
        ((i, len(s), least.get(find(at)) if s else i) for at, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr
    )


def found(docs):
    return sorted((tuple(r) for r in ngram_join.joined_sets(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_edges(edges):
    assert found(edges) == brute(edge_texts())


def test_empty(empty):
    assert found(empty) == []


def test_groups_of_near_copies(spark):
    draw = random.Random(7)
    rows, base = [], words(11, 160)
    for doc_id in range(120):
        text = list(base)
        for _ in range(draw.randrange(4)):
            text[draw.randrange(len(text))] = f"new{draw.randrange(10**6)}"
        rows.append((doc_id, " ".join(text)))
    # A chain: each like its neighbour, not like those farther off.
    chain = words(12, 140)
    for doc_id in range(200, 215):
        rows.append((doc_id, " ".join(chain)))
        at = (doc_id - 200) * 8
        chain = chain[:at] + words(doc_id, 3) + chain[at + 3 :]
    # One passage that many otherwise different documents share.
    shared = words(13, 60)
    rows += [(300 + k, " ".join(words(1000 + k, 90, 10**6) + shared)) for k in range(80)]
    rows += [(400 + k, " ".join(shared + words(2000 + k, 9, 10**6))) for k in range(40)]
    assert found(frame(spark, rows)) == brute(rows)


def test_at_the_threshold(spark):
    # Sets of n + 4 words have n shingles; a cut at the end leaves exactly 80 or just less of 100.
    base = words(21, 104, 10**6)
    rows = [(1, " ".join(base)), (2, " ".join(base[:84])), (3, " ".join(words(22, 104, 10**6))), (4, " ".join(words(22, 104, 10**6)[:83]))]
    assert found(frame(spark, rows)) == brute(rows)
    assert [c for _, _, c in found(frame(spark, rows))] == [1, 1, 3, 4]


def test_one_document_of_each_group_stays(edges):
    left = ngram_join.distinct_documents(edges)
    assert left.columns == edges.columns
    ids = sorted((r.doc_id for r in left.collect()), key=repr)
    groups = {}
    for doc_id, text in edge_texts():
        groups.setdefault(shingle_set(text), []).append(doc_id)
    assert -5 in ids and 0 in ids and 1 not in ids and 2 not in ids
    assert ids.count(22) == 0 and ids.count(23) == 2
    assert ids.count(None) == 2 and {4, 5, 6} <= set(ids)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(149, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 150), 200], 100)}


def test_rounds_write_few_files(spark, monkeypatch):
    tasks = {}
    stage = components.common.stage

    def counted(df, name, free=False):
        out = stage(df, name, free)
        tasks.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components.common, "stage", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        edges = spark.createDataFrame([(n, n + 1) for n in range(300) if n % 10], "a long, b long")
        got = {r.node: r.component for r in components.components(edges).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(got) == 300 and all(least == (node - 1) // 10 * 10 + 1 for node, least in got.items())
    assert len(tasks["links"]) > 1 and max(tasks["links"]) <= spark.sparkContext.defaultParallelism
