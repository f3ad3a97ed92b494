import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *(T.StructField(n, T.StringType()) for n in (
            "text_hash", "key", "kind", "data", "spans", "members", "row", "hash", "id", "score", "part", "toxic", "held_out",
            "times", "fragment", "place", "file", "block", "content", "page")),
    ]
)


def words(seed, n, stock=400):
    """Invented words, the same for a seed."""
    draw = random.Random(seed)
    return [f"w{draw.randrange(stock)}x{seed % 7}" for _ in range(n)]


def edge_texts():
    """Texts that stand at an edge of some operator."""
    a, b = words(1, 300), words(2, 260)
    passage = words(3, 60)
    near = list(a)
    near[150] = "changed"
    return [
        (0, " ".join(a)), (1, " ".join(a)), (2, " ".join(near)), (3, " ".join(b)), (4, None), (5, ""), (6, " \t\n "),
        (7, "One"), (8, "one"), (9, "two words"), (10, "a b c d"), (11, "A  b\tc\nd"), (12, " ".join(b[:100] + passage + b[150:])),
        (13, " ".join(words(5, 120) + passage)), (14, " ".join(passage + passage)), (15, "na " * 400),
        (16, "Ünï çödé ß " * 40), (17, "x" * 30_000), (18, "1" * 30_000), (19, " ".join(words(6, 30_000))),
        (20, " ".join(words(6, 30_000)[:-500])), (21, "… — \x00"), (None, "no id here at all, none"), (22, " ".join(b)),
        (22, " ".join(b)), (23, " ".join(words(8, 50))), (23, " ".join(words(9, 50))), (None, None), (-5, " ".join(a[:200])),
    ]


def frame(spark, rows):
    """Documents with all columns; the extra ones hold a mark."""
    full = [
        (i, t, ["en", "de", None][k % 3], ["s1", "s2", None][k % 3], len(t or ""), *["mark"] * (len(DOCUMENTS) - 5))
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, DOCUMENTS)


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_texts()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
