"""Token counts from flat token files by a separator scan.

A token file is a run of fixed-width identifiers; documents follow one another,
each ended by the end-of-document identifier, and no index says where. Files are
read in blocks that pay no heed to documents. Each block is searched for
separators by one vectorised comparison and yields its number of separators, the
lengths of documents that lie wholly within it, and the pieces before its first
and after its last separator. A prefix scan over the blocks of a file (running
sums of separators, in two levels) numbers the documents; pieces with one number
are summed, which stitches documents across any number of blocks.

Defined results: an empty document counts 0; a null text is an empty one; tokens
after the last separator are a document that is not ``ended``; an empty file has
no documents; repeated documents each get their row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from blattwerk.sources import stores

from . import common

#: Public vocabulary file (ranks), its splitting pattern, and the identifier that it leaves free.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Identifiers per block, and their width in the files.
BLOCK = 1 << 16
WIDTH = 2
#: Blocks of a file that are summed together before the second level.
GROUP = 1024
#: Blocks of a token file that a task opens it for, and bytes of files per task.
RUN = 64
TASK_BYTES = 128 << 20
_NONE = np.iinfo(np.int64).min


#: White space that the tokenizer's pattern knows, in runs that its search may not survive.
LONG_RUN = 10_000
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG = re.compile(f"[{_BLANKS}]{{{LONG_RUN},}}")


def _encoding(path: str, pattern: str) -> object:
    def make() -> object:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return common.held("encoding", (path, pattern), make)


def encoder(tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    """Identifiers of a text.

    With ``PATTERN`` a long run of white space is one piece, but for its last
    character where text follows. The search for that piece steps back through
    the run and ends the process on very long ones, so such runs are cut out
    beforehand, at the places where the pattern would cut.
    """
    encoding = _encoding(tokenizer, pattern)
    if pattern != PATTERN:
        return encoding.encode_ordinary

    def encode(text: str) -> list[int]:
        found, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() - (run.end() < len(text))
            found += encoding.encode_ordinary(text[at : run.start()])
            found += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return found + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)

    return encode


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN, end: int = END, width: int = WIDTH
) -> DataFrame:
    """Write documents to token files below ``path``, one per task and attempt; returns the files of those that ended well.

    ``<file>.tokens`` is flat: identifiers of ``width`` bytes (little endian), each
    document followed by ``end``, and nothing else. ``<file>.ids`` has the documents'
    ids in the same order, 8 bytes each. An identifier that does not fit is an error.
    Returns (file, tokens, ids): the path without its ending, and both lengths.
    """
    kind, most = np.dtype(f"<u{width}"), 1 << (8 * width)
    target = stores.full(path)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern)
        if max(end, _encoding(tokenizer, pattern).max_token_value) >= most:
            raise ValueError(f"identifiers of {tokenizer} do not fit {width} bytes")
        task = TaskContext.get()
        name = f"{target}/{task.partitionId()}-{task.taskAttemptId()}"
        store, key = stores.located(name)
        store.create_dir(key.rpartition("/")[0], recursive=True)
        sizes = [0, 0]
        with store.open_output_stream(f"{key}.tokens") as tokens, store.open_output_stream(f"{key}.ids") as ids:
            for batch in common.batches(rows, 256):
                parts = []
                for text in common.blobs(batch, "text"):
                    parts += [np.array(encode(text or ""), kind), np.array([end], kind)]
                numbers = np.array([_NONE if i is None else i for i in common.blobs(batch, "doc_id")], "<i8")
                for at, (file, data) in enumerate(((tokens, np.concatenate(parts)), (ids, numbers))):
                    file.write(data.tobytes())
                    sizes[at] += data.nbytes
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array(sizes[:1], pa.int64()), pa.array(sizes[1:], pa.int64())], names=["file", "tokens", "ids"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stage(rows.mapInArrow(write, "file string, tokens long, ids long"), "token-files")


def _opened(path: str) -> pa.NativeFile:
    """A file of a store that Arrow reads, for reads at any place."""
    scheme, host, key = re.fullmatch(r"(?:([a-z0-9]+):)?(?://([^/]*))?(/.*)", path).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file(key)
    store, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host or ''}/")
    return store.open_input_file(base.rstrip("/") + key)


def read_files(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Blocks (file path, block, data) of token files in a folder, of any length; see ``read_listed``."""
    return read_listed(spark.read.format("binaryFile").load(path).select("path", "length"), width, block, run)


def read_listed(found: DataFrame, width: int = WIDTH, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Blocks (file path, block, data) of the token files ``(path, length)``.

    Files are listed without their content; runs of ``run`` blocks are dealt over
    the cluster, and a task reads just its runs' bytes, a block at a time. This goes
    through Arrow's file systems (local, S3, GCS, ABFS, HDFS), which workers have to
    be able to open; files of other stores fail.
    """
    size = width * block

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, length, first in zip(*(common.blobs(batch, k) for k in ("path", "length", "first")), strict=True):
                with _opened(name) as file:
                    for number in range(first, min(first + run, max(1, -(-length // size)))):
                        wanted = min(size, length - number * size)
                        data = file.read_at(wanted, number * size)
                        if len(data) < wanted:
                            raise OSError(f"{name} is shorter than when it was listed")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                            names=["file", "block", "data"],
                        )

    spark = found.sparkSession
    total = found.agg(F.sum("length")).head()[0] or 0
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    runs = found.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(run).cast("long"))))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return runs.repartition(tasks, "path", "first").mapInArrow(cut, "file string, block long, data binary")


def scan(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens, ended): every document of every file, in order from 0."""
    file = blocks.schema["file"].dataType.simpleString()

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows, 64):
            seps, heads, tails, inner = [], [], [], []
            for data in common.blobs(batch, "data"):
                own = np.frombuffer(data or b"", f"<u{width}")
                at = np.flatnonzero(own == end)
                seps.append(len(at))
                heads.append(int(at[0]) if len(at) else len(own))
                tails.append(len(own) - int(at[-1]) - 1 if len(at) else 0)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seps, pa.int64()), pa.array(heads, pa.int64()),
                 pa.array(tails, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "seps", "head", "tail", "inner"],
            )

    found = common.stage(
        blocks.select("file", "block", "data").mapInArrow(
            search, f"file {file}, block long, seps long, head long, tail long, inner array<long>"
        ),
        "separators",
    )
    group = F.floor(F.col("block") / GROUP)
    narrow = found.select("file", "block", "seps", group.alias("part"))
    parts = narrow.groupBy("file", "part").agg(F.sum("seps").alias("all"))
    before_part = F.sum("all").over(W.partitionBy("file").orderBy("part")) - F.col("all")
    before = F.sum("seps").over(W.partitionBy("file", "part").orderBy("block")) - F.col("seps")
    places = (
        narrow.withColumn("within", before)
        .join(parts.select("file", "part", before_part.alias("before")), ["file", "part"])
        .select("file", "block", (F.col("within") + F.col("before")).alias("first"))
    )
    numbered = found.join(places, ["file", "block"])
    whole = numbered.select("file", "first", F.posexplode("inner").alias("at", "n_tokens")).select(
        "file", (F.col("first") + 1 + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended")
    )
    # Two pieces per block at most: what may continue in a neighbour.
    pieces = numbered.select(
        "file",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("ordinal"), F.col("head").alias("n"), (F.col("seps") > 0).alias("ended")),
                F.struct((F.col("first") + F.col("seps")).alias("ordinal"), F.col("tail").alias("n"), F.lit(False).alias("ended")),
            )
        ).alias("piece"),
    ).select("file", "piece.*")
    stitched = pieces.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("ended").alias("ended"))
    return whole.unionByName(stitched.where("ended or n_tokens > 0"))


def document_tokens(
    docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, end: int = END, block: int = BLOCK
) -> DataFrame:
    """doc_id and n_tokens of every document, through flat files and the scan."""
    files = write_token_files(docs, common.new_table_path(docs.sparkSession, "tokens"), tokenizer, pattern, end)

    def blocks(kind: str, width: int) -> DataFrame:
        found = files.select(F.concat("file", F.lit(f".{kind}")).alias("path"), F.col(kind).alias("length")).where("length > 0")
        # A file is known by the number of the attempt that wrote it.
        number = F.regexp_extract("file", rf"([0-9]+)\.{kind}$", 1).cast("long")
        return read_listed(found, width, block).withColumn("file", number)

    def order(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, number, data in zip(*(common.blobs(batch, k) for k in ("file", "block", "data")), strict=True):
                ids = np.frombuffer(data, "<i8")
                first = number * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), file)), pa.array(np.arange(first, first + len(ids))), pa.array(ids, mask=ids == _NONE)],
                    names=["file", "ordinal", "doc_id"],
                )

    counts = scan(blocks("tokens", WIDTH), end)
    names = blocks("ids", 8).mapInArrow(order, "file long, ordinal long, doc_id long")
    # Spark takes what is read from a list of files for as small as the list; both sides are large.
    return names.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(common.table(spark, folder, "documents"))
