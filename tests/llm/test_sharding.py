"""Sharding against a plain version, the law of moves, slots of hot shards, files."""

import hashlib
import math
import zlib

from llm import common, sharding
from pyspark.sql import functions as F
from tests.llm.conftest import frame


def winner(key, weights):
    def cost(shard):
        digits = hashlib.md5(f"shard:{shard}:{key}".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 0.5) / 2**52) / weights[shard]

    return min((cost(s), s) for s in range(len(weights)) if weights[s] > 0)[1]


def plain(rows, weights, new_weight=1.0):
    def digest(row):
        return hashlib.md5(":".join(["slot", "null" if row[0] is None else str(row[0]), str(row[1]), str(row[2])]).encode()).hexdigest()

    found, seen = [], {}
    records = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    for record in sorted(records, key=lambda r: (digest(r), r[0] is not None, r[0] or 0)):
        key = "null" if record[0] is None else str(record[0])
        shard = winner(key, weights)
        found.append((*record, shard, seen.get(shard, 0), winner(key, [*weights, new_weight])))
        seen[shard] = seen.get(shard, 0) + 1
    return found


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_edges(spark, edges, empty):
    texts = [(r.doc_id, r.text) for r in edges.collect()]
    assert ordered(sharding.shards(edges).collect()) == ordered(plain(texts, sharding.WEIGHTS))
    assert sharding.shards(empty).collect() == []


def test_weights_and_repeated_rows(spark, monkeypatch):
    """A third of all rows are one record; another third share an id; a run spans several pieces."""
    monkeypatch.setattr(sharding, "RUN", 7)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = [(5, "again")] * 200 + [(6, f"text {n}") for n in range(200)] + [(n, None) for n in range(100, 300)]
    weights = (1.0, 0.0, 3.0, 0.5)
    got = sharding.shards(frame(spark, rows), weights, new_weight=2.0).collect()
    assert ordered(got) == ordered(plain(rows, weights, 2.0))
    assert {r.shard for r in got} <= {0, 2, 3} and len({r.shard for r in got if r.doc_id == 6}) == 1
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_moves_follow_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    even, more, heavy = (1.0,) * 4, (1.0,) * 5, (1.0, 1.0, 2.0, 1.0)
    grown = {(r.shard, r.new_shard): r.records for r in sharding.moves(docs, even, more).collect()}
    assert all(a == b or b == 4 for a, b in grown)
    assert 3_600 < sum(n for (a, b), n in grown.items() if a != b) < 4_400
    raised = {(r.shard, r.new_shard): r.records for r in sharding.moves(docs, even, heavy).collect()}
    assert all(a == b or b == 2 for a, b in raised)
    held = {b: sum(n for (_, d), n in raised.items() if d == b) for b in range(4)}
    assert 7_600 < held[2] < 8_400 and all(3_600 < held[b] < 4_400 for b in (0, 1, 3))


def test_files_hold_all_rows(spark, edges):
    path = f"{common.new_table_path(spark, 'shard-files')}"
    sharding.write_shards(edges, path, (1.0, 2.0), file_rows=4)
    read = spark.read.parquet(path)
    want = sharding.with_shards(edges, (1.0, 2.0), "_shard")
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in [*edges.columns, "_shard"]]
    assert sorted(map(tuple, read.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    files = read.groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).head()[0] <= 4


def test_no_weight(spark, edges):
    import pytest

    with pytest.raises(ValueError, match="weight"):
        sharding.with_shards(edges, (0.0, 0.0))
