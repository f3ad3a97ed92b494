"""Members of JSON objects of any length, read by many tasks.

Spark cuts a text file into ranges of bytes at a separator. Here that is the
closing brace, so no line has to be short, and a piece is what stands before one.
Whether a brace ends a member depends on all that stands before it: inside a
string it does not count, and elsewhere it does only at the object's own level.
Both are sums over the file. Each range gives its number of quotes (odd or even)
and its change of depth for either way of starting; running sums over the ranges
of a file tell every range how it starts, and a second pass cuts it into members.
Members that lie across ranges are joined afterwards, from one or two fragments
a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blattwerk.session import stage

END = "}"
# Ranges whose state is sent to all tasks; beyond, pieces are dealt by range.
BROADCAST_RANGES = 50_000
# Bytes that a task looks at together (or one piece, if that is longer).
LOOK = 1 << 20

_DEPTH = np.zeros(256, np.int64)
_DEPTH[list(b"{[")] = 1
_DEPTH[list(b"}]")] = -1

PIECE = ["path", "start", "value"]
STATE = "path string, start long, odd int, outside long, inside long"
MEMBERS = "path string, start long, place long, fragment boolean, closed boolean, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of one range, some ``LOOK`` bytes at a time, and the batch cut down to them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        paths = batch.column("path").dictionary_encode().indices.to_numpy()
        looks = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64)) // LOOK
        cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(paths) != 0) | (np.diff(looks) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(starts)], strict=True):
            part = batch.slice(low, high - low)
            yield part, part.column("value").to_pylist()


def _seen(pieces: list[bytes], in_string: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the pieces, ends included: whether it is in a string, its step of depth; and where pieces end."""
    data = END.encode().join([*pieces, b""])
    if b"\\" in data:
        # What is escaped neither opens nor closes anything; lengths stay.
        data = re.sub(rb"\\.", b"__", data, flags=re.DOTALL)
    codes = np.frombuffer(data, np.uint8)
    inside = (np.cumsum(codes == ord('"')) + in_string) & 1
    ends = np.cumsum([len(piece) + 1 for piece in pieces]) - 1
    return inside, _DEPTH[codes], ends


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether its quotes are odd, and its change of depth if it starts outside or inside a string."""
    key, odd, change = None, 0, [0, 0]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"path": key[0], "start": key[1], "odd": odd, "outside": change[0], "inside": change[1]}],
            schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())]),
        )

    for part, pieces in _runs(batches):
        here = (part.column("path")[0].as_py(), part.column("start")[0].as_py())
        if here != key:
            if key is not None:
                yield out()
            key, odd, change = here, 0, [0, 0]
        inside, step, _ = _seen(pieces)
        own = [int(step[inside == 0].sum()), int(step[inside == 1].sum())]
        change = [change[start] + own[start ^ odd] for start in (0, 1)]
        odd ^= int(inside[-1])
    if key is not None:
        yield out()


class _Cutter:
    """Cuts the pieces of one range into members; keeps what is open."""

    def __init__(self, path: str, start: int, in_string: int, depth: int) -> None:
        self.path, self.start, self.in_string, self.depth = path, start, in_string, depth
        self.place, self.open = 0, []

    def row(self, text: bytes, closed: bool) -> dict:
        fragment = not closed or (self.place == 0 and self.start > 0)
        row = {
            "path": self.path, "start": self.start, "place": self.place, "fragment": fragment, "closed": closed,
            "text": text.decode("utf-8", "replace"),
        }
        self.place += 1
        return row

    def cut(self, pieces: list[bytes]) -> Iterator[dict]:
        inside, step, ends = _seen(pieces, self.in_string)
        depth = self.depth + np.cumsum(np.where(inside == 0, step, 0))
        after, free = depth[ends], inside[ends] == 0
        low = 0
        for at in np.flatnonzero(free & (after <= 1)):
            # The object's own brace (depth 0) is no part of its last member.
            end = END.encode() if after[at] == 1 else b""
            yield self.row(END.encode().join([*self.open, *pieces[low : at + 1]]) + end, True)
            self.open, low = [], at + 1
        self.open += pieces[low:]
        self.in_string, self.depth = int(inside[-1]), int(depth[-1])

    def rest(self) -> Iterator[dict]:
        """What is open at the end; behind the last object there is nothing to keep."""
        if self.open and self.depth + (1 if self.in_string else 0) > 0:
            yield self.row(END.encode().join([*self.open, b""]), False)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("fragment", pa.bool_()),
        ("closed", pa.bool_()), ("text", pa.string())])
    cutter = None
    for part, pieces in _runs(batches):
        here = (part.column("path")[0].as_py(), part.column("start")[0].as_py())
        if cutter is None or here != (cutter.path, cutter.start):
            if cutter is not None:
                yield pa.RecordBatch.from_pylist(list(cutter.rest()), schema=schema)
            cutter = _Cutter(*here, part.column("in_string")[0].as_py(), part.column("depth")[0].as_py())
        yield pa.RecordBatch.from_pylist(list(cutter.cut(pieces)), schema=schema)
    if cutter is not None:
        yield pa.RecordBatch.from_pylist(list(cutter.rest()), schema=schema)


def _states(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """How every range but a file's first one starts; files of one range are not read."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    # Spark does not cut files below both of these.
    least = min(int(str(spark.conf.get(name)).removesuffix("b")) for name in sizes)
    cut = pieces.where((F.col("size") > least) & (F.col("length") < F.col("size"))).select(*PIECE)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    return (
        cut.mapInArrow(_summaries, STATE)
        .withColumn("in_string", odd.cast("int"))
        .withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .where("start > 0")
        .select("path", "start", "in_string", "depth")
    )


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``(path, start, place, text)``: pieces of the JSON objects in the files, each an object of its own.

    A file may hold one object or several after each other, over any lines.
    ``text`` is an object of one or more whole members; (start, place) orders the
    pieces of a file. Members whose values are no objects go with the next one
    that is. Files without an object give no row, and of a file that ends early the
    members before stay.
    """
    pieces = _pieces(spark, path)
    states = stage(_states(spark, pieces), "json-ranges")
    ranges = states.count()
    rows = pieces.select(*PIECE)
    if ranges:
        if ranges <= BROADCAST_RANGES:
            rows = rows.join(F.broadcast(states), ["path", "start"], "left")
        else:
            rows = (
                rows.withColumn("at", F.monotonically_increasing_id())
                .join(states, ["path", "start"], "left")
                .sortWithinPartitions("path", "start", "at")
            )
        state = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("in_string", "depth")]
    else:
        state = [F.lit(0).alias("in_string"), F.lit(0).cast("long").alias("depth")]
    cut = rows.select(*PIECE, *state).mapInArrow(_members, MEMBERS)
    whole = cut
    if ranges:
        cut = stage(cut, "json-members")
        # One or two fragments a range: those up to a closed one are one text.
        order = Window.partitionBy("path").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
        closed = F.coalesce(F.sum(F.col("closed").cast("long")).over(order), F.lit(0))
        joined = (
            cut.where("fragment").withColumn("chain", closed)
            .groupBy("path", "chain")
            .agg(
                F.max("start").alias("start"), F.lit(0).cast("long").alias("place"),
                F.expr("listagg(text) WITHIN GROUP (ORDER BY start, place)").alias("text"),
            )
        )
        whole = cut.where("NOT fragment").select("path", "start", "place", "text").unionByName(joined.drop("chain"))
    opened = F.regexp_replace("text", r"^[\s,]*\{?[\s,]*", "{")
    return whole.select("path", "start", "place", F.concat(opened, F.lit(END)).alias("text"))
