"""Lempel-Ziv fingerprints against a plain parse; token counts against the tokenizer."""

import hashlib
import re

import numpy as np
import pytest
from llm import lz_fingerprint as lz, token_counts
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tests.llm.conftest import edge_texts, frame, words


def phrase_ends(data):
    known, ends, start = set(), [], 0
    for at in range(1, len(data) + 1):
        if data[start:at] not in known:
            known.add(data[start:at])
            ends.append(at)
            start = at
    return ends


def test_parse():
    for _, text in edge_texts():
        data = (text or "").encode()[:20_000]
        half = len(data) // 3
        assert lz.Parse().read(data).ends == phrase_ends(data)
        state = lz.Parse().read(data[:half])
        assert state.ends_with(data[half:]) == phrase_ends(data)
        assert state.ends_with(data[half:] * 2) == phrase_ends(data[:half] + data[half:] * 2)


def test_likeness_follows_what_is_shared():
    a, b = (" ".join(words(s, 800, 10**6)).encode() for s in (1, 2))
    sign = lambda d: lz.signature(d, lz.Parse().read(d).ends)
    mixed = a[: len(a) // 2] + b[: len(b) // 2]
    assert lz.likeness(sign(a), sign(a)) == 1
    assert lz.likeness(sign(a), sign(mixed)) > lz.likeness(sign(a), sign(b)) + 0.15
    assert lz.likeness(None, None) == 1 and lz.likeness(None, sign(a)) == 0


def test_neighbours(spark, empty):
    rows = sorted({i: (i, t) for i, t in edge_texts()}.values(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in lz.neighbours(frame(spark, rows).repartition(4)).collect()}
    assert len(got) == len(rows)
    for at, (doc_id, text) in enumerate(rows):
        own, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[doc_id]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (lz.fingerprint(own), lz.fingerprint(edited))
        sign = lambda t: lz.signature(t.encode(), lz.Parse().read(t.encode()).ends)
        assert r.near_edited == lz.likeness(sign(own), sign(edited)) and r.near_next == lz.likeness(sign(own), sign(after))
    assert lz.neighbours(empty).count() == 0
    (only,) = lz.neighbours(frame(spark, [(1, "abcd")])).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1


def test_equal_texts_have_equal_fingerprints(edges):
    got = {}
    for r in lz.fingerprints(edges).collect():
        got.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert got[0] == got[1] != got[3] and got[4] == got[5] == {""} and len(got[22]) == 1 and len(got[23]) == 2


def test_token_counts(edges, empty):
    encode = token_counts._encoding(token_counts.TOKENIZER, token_counts.PATTERN).encode_ordinary
    want = sorted(((i, len(encode(t or ""))) for i, t in edge_texts()), key=repr)
    for block in (3, token_counts.BLOCK):
        assert sorted((tuple(r) for r in token_counts.document_tokens(edges, block=block).collect()), key=repr) == want
    assert token_counts.document_tokens(empty).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t\x85"])
def test_long_runs_are_cut_where_the_pattern_cuts(monkeypatch, blank):
    plain = token_counts._encoding(token_counts.TOKENIZER, token_counts.PATTERN).encode_ordinary
    monkeypatch.setattr(token_counts, "_LONG", re.compile(f"[{token_counts._BLANKS}]{{2,}}"))
    encode = token_counts.encoder()
    for n in (0, 1, 2, 3, 7, 500):
        run = blank * n
        for text in (run, f"a{run}b", f"{run}1", f"x.{run}", f"it's{run}'s{run}!?{run}Ü {run}\x1c{run}", f"\x1f{run}\x1fz"):
            assert encode(text) == plain(text), (n, text[:20])


def test_very_long_blank_run(spark):
    texts = [(1, "a" + " " * 2_000_000 + "b"), (2, " " * 1_000_000), (3, "c")]
    got = dict(map(tuple, token_counts.document_tokens(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    piece = token_counts._encoding(token_counts.TOKENIZER, token_counts.PATTERN)._encode_single_piece
    assert got == {1: 2 + len(piece(" " * 1_999_999)), 2: len(piece(" " * 1_000_000)), 3: 1}


def test_identifiers_that_do_not_fit(spark, edges, tmp_path):
    with pytest.raises(PySparkException, match="do not fit"):
        token_counts.write_token_files(edges, str(tmp_path), width=1)


def test_scan_stitches_over_blocks(spark, tmp_path):
    draw = np.random.default_rng(4)
    lengths = [0, 0, 5, 100, 1, 0, 37, 64, 63, 65, 1000, 0]
    files = {}
    for name, tail in (("a", 0), ("b", 9), ("c", 0)):
        own = [*lengths] if name != "c" else []
        data = [np.append(draw.integers(0, 50, n), 99) for n in own] + [draw.integers(0, 50, tail)]
        np.concatenate(data).astype("<u2").tofile(tmp_path / name)
        files[name] = [(n, True) for n in own] + ([(tail, False)] if tail else [])
    for block in (1, 7, 64, 5000):
        blocks = token_counts.read_files(spark, str(tmp_path), block=block)
        got = {}
        for r in token_counts.scan(blocks, end=99).orderBy("file", "ordinal").collect():
            got.setdefault(r.file[-1], []).append((r.ordinal, r.n_tokens, r.ended))
        assert got == {n: [(at, *v) for at, v in enumerate(vs)] for n, vs in files.items() if vs}


def test_token_files_are_read_by_ranges(spark, tmp_path):
    own = np.random.default_rng(5).integers(0, 50, 3001).astype("<u2")
    for name in ("a b", "c%20d"):
        own.tofile(tmp_path / name)
    (tmp_path / "empty").touch()
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")  # Spark reads no file above this whole; 2 GB by default
    try:
        blocks = token_counts.read_files(spark, str(tmp_path), block=100, run=3)
        rows = blocks.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(limit)
    for name in ("a b", "c%20d"):
        mine = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.block)
        assert [r.block for r in mine] == list(range(31))
        assert b"".join(r.data for r in mine) == own.tobytes() and len({r.task for r in mine}) > 1
    assert not any(r.file.endswith("empty") for r in rows)


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_fingerprint(text):
    """Phrases one by one, and the least hash of each of 128 parts; an empty part asks the next full one."""
    data, parts, start = text.encode(), {}, 0
    for end in phrase_ends(data):
        value = plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, at, 2**64) for at, b in enumerate(data[start:end])) % 2**64)
        parts[value >> 57] = min(value, parts.get(value >> 57, value))
        start = end
    out = bytearray()
    for part in range(128):
        distance = next((d for d in range(128) if (part + d) % 128 in parts), None)
        if distance is None:
            return ""
        out.append(plain_mix((parts[(part + distance) % 128] + distance * 0x9E3779B97F4A7C15) % 2**64) & 0xFF)
    return out.hex()


@pytest.mark.parametrize("chunk", [1, 13, 1 << 18])
def test_fingerprint_against_a_plain_one(monkeypatch, chunk):
    monkeypatch.setattr(lz, "CHUNK", chunk)
    for text in ("", "a", "na na na", "Ünï çödé", " ".join(words(3, 300)), "x" * 3000, "".join(map(chr, range(1, 900)))):
        assert lz.fingerprint(text) == plain_fingerprint(text)
