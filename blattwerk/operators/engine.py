"""Model pass: a pluggable function over request batches.

Only the request column travels to Python; all other columns of a row stay in
the JVM and are put back beside the reply, so there is no join afterwards.
"""

from __future__ import annotations

import hashlib
import sys
import time
import types
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from blattwerk import fixed, schemas
from blattwerk.operators import model_process
from blattwerk.operators.model_process import Model


# Loading may fetch a model first.
LOAD_TIMEOUT_SECONDS = 1800.0


class Engine(NamedTuple):
    """``load`` runs once per Python worker, in a process beside it, and gives the
    function that answers a list of requests (dicts of the request fields) with a
    list of texts, or with an iterator that gives them one by one."""

    name: str
    load: Callable[[], Model]


def _worker(key: str, code: bytes) -> model_process.Worker:
    """This worker's model for an engine; it outlives the task."""
    held = sys.modules.setdefault("blattwerk_models", types.ModuleType("blattwerk_models")).__dict__
    if key not in held:
        held[key] = model_process.Worker(code, LOAD_TIMEOUT_SECONDS)
    return held[key]


def _answer(worker: model_process.Worker, requests: list[dict], retries: int, timeout: float) -> list[tuple]:
    """``(text, seconds, error)`` per request.

    A failed call is halved, and halves are asked in turn, so that one bad request
    costs two calls per halving. Of a model that answers one by one only the
    request at fault is left, and asked again last. A single request is asked
    ``retries`` times more. A model that ends more calls than that (and than two, as
    one request may be in a call and its half) without a reply in between is given
    up for this batch, and gets one call in the next.
    """
    start = time.perf_counter()
    texts: list[str | None] = [None] * len(requests)
    errors: list[str | None] = [None] * len(requests)
    tries = [0] * len(requests)
    groups = deque([list(range(len(requests)))])
    patience = max(2, retries)
    worker.silent = min(worker.silent, patience)
    while groups and worker.silent <= patience:
        group = groups.popleft()
        found, one_by_one, fault = worker.ask([requests[at] for at in group], timeout)
        for at, text in zip(group, found, strict=False):
            texts[at], errors[at] = text, None
        left = group[len(found) :]
        for at in left:
            errors[at] = fault
        if not left:
            continue
        if len(left) > 1 and not one_by_one:
            groups.extend([left[: len(left) // 2], left[len(left) // 2 :]])
            continue
        if left[1:]:
            groups.append(left[1:])
        tries[left[0]] += 1
        if tries[left[0]] <= retries:
            groups.append(left[:1])
    share = (time.perf_counter() - start) / len(requests)
    return [(text, share, error) for text, error in zip(texts, errors, strict=True)]


def request_key(engine: Engine, request: str | Column = "request") -> Column:
    """Key of a request to an engine; null where no call is to be made."""
    request = F.col(request) if isinstance(request, str) else request
    content = F.concat(F.lit(f"{engine.name}\n"), F.to_json(request))
    return F.when(request["prompt"].isNotNull(), F.sha2(content, 256))


def _asked_once(rows: DataFrame, engine: Engine, replies: str, partitions: int | None, **settings: object) -> DataFrame:
    """Rows with their replies from the table ``replies``; requests without one there are asked first."""
    spark = rows.sparkSession
    # The table exists from here on, and tasks that are done keep their replies if the run fails.
    spark.createDataFrame([], schemas.STORED_REPLY).write.mode("append").parquet(replies)
    stored = spark.read.schema(schemas.STORED_REPLY).parquet(replies)
    keyed = rows.withColumn("__key", request_key(engine))
    asked = (
        keyed.where(F.col("__key").isNotNull())
        .groupBy(F.col("__key").alias("key"))
        .agg(F.first("request").alias("request"))
        .join(stored.where("error IS NULL").select("key"), "key", "left_anti")
    )
    if partitions:
        asked = asked.repartition(partitions, "key")
    found = apply_engine(asked, engine, **settings)
    found.select(
        "key", F.col("reply").alias("text"), F.col("reply_seconds").alias("seconds"), F.col("reply_error").alias("error"),
        F.current_timestamp().alias("at"),
    ).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(replies)
    # A reply counts before any error, then the latest.
    stored = spark.read.schema(schemas.STORED_REPLY).parquet(replies)
    best = stored.groupBy(F.col("key").alias("__key")).agg(
        F.max_by(F.struct("text", "seconds", "error"), F.struct(F.col("error").isNull(), "at")).alias("__reply")
    )
    blank = F.col("__key").isNull()
    return (
        keyed.drop("request").join(best, "__key", "left")
        .withColumn("reply", F.when(blank, F.lit("")).otherwise(F.col("__reply.text")))
        .withColumn("reply_seconds", F.when(blank, F.lit(0.0)).otherwise(F.col("__reply.seconds")))
        .withColumn("reply_error", F.col("__reply.error"))
        .drop("__key", "__reply")
    )


def apply_engine(
    rows: DataFrame,
    engine: Engine,
    batch_size: int = 64,
    retries: int = fixed.CALL_RETRIES,
    timeout: float = fixed.CALL_TIMEOUT_SECONDS,
    spread_by: tuple[str, ...] = (),
    partitions: int | None = None,
    strip: bool = True,
    replies: str | None = None,
) -> DataFrame:
    """Replaces ``request`` by ``reply``, ``reply_seconds`` and ``reply_error``.

    A request without prompt gives the empty reply and no call. ``spread_by``
    (a key that differs from row to row, such as document and page) evens out
    the rows over tasks first; use it after a step that leaves many rows of one
    document together. Write the result with ``stage`` before using it twice. A
    call gets ``batch_size`` requests, gathered across Arrow batches; only the last
    call of a task gets fewer. ``strip`` takes white space off the ends of replies.

    ``replies`` is a folder for a table of replies by request. Equal requests are
    asked once, and a later run asks only those that have no reply there, be it
    that their call failed or that the run did not come to them; replies are
    joined to the rows, so this costs shuffles. They are kept as the model gave
    them with this ``strip``; use one folder per way of asking.
    """
    if replies is not None:
        settings = {"batch_size": batch_size, "retries": retries, "timeout": timeout, "strip": strip}
        return _asked_once(rows, engine, replies, partitions, **settings)
    retries, timeout = max(0, retries), max(1.0, timeout)
    code = model_process.payload(engine.load)
    key = f"{engine.name}-{hashlib.sha256(code).hexdigest()}"

    @F.pandas_udf(schemas.REPLY)
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Replies of an Arrow batch by place, and how many are still asked for.
        waiting: deque[tuple[list[tuple], list[int]]] = deque()
        asked: deque[tuple[list[tuple], list[int], int, dict]] = deque()

        def ask(count: int) -> None:
            batch = [asked.popleft() for _ in range(count)]
            answers = _answer(_worker(key, code), [record for *_, record in batch], retries, timeout)
            for (out, left, at, _), (text, seconds, error) in zip(batch, answers, strict=True):
                out[at] = (text.strip() if strip and text is not None else text, seconds, error)
                left[0] -= 1

        def done() -> Iterator[pd.DataFrame]:
            while waiting and not waiting[0][1][0]:
                yield pd.DataFrame(waiting.popleft()[0], columns=["text", "seconds", "error"]).astype({"seconds": float})

        for frame in batches:
            out = [("", 0.0, None)] * len(frame)
            places = [at for at, prompt in enumerate(frame["prompt"]) if prompt is not None]
            left = [len(places)]
            waiting.append((out, left))
            records = frame.iloc[places].to_dict("records")
            asked.extend((out, left, at, record) for at, record in zip(places, records))
            while len(asked) >= batch_size:
                ask(batch_size)
            yield from done()
        if asked:
            ask(len(asked))
        yield from done()

    if spread_by:
        count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(count, *spread_by)
    return (
        rows.withColumn("__reply", call(F.col("request")))
        .withColumn("reply", F.col("__reply.text"))
        .withColumn("reply_seconds", F.col("__reply.seconds"))
        .withColumn("reply_error", F.col("__reply.error"))
        .drop("request", "__reply")
    )
