"""One file per row, written by many tasks and shown at the end.

Tasks write below a temporary folder and note what they wrote in a table, which
holds the notes of successful attempts alone. A second pass gives those files
their names; it may be repeated. A run that fails before leaves no file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from blattwerk.session import stage
from blattwerk.sources import stores


def file_name(name: str | None) -> str:
    """A relative file name: no scheme, and no step out of the folder."""
    parts = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", name or "").split("/")
    kept = "/".join(part for part in parts if part not in ("", ".", ".."))
    if not kept:
        raise ValueError(f"kein Dateiname: {name!r}")
    return kept


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write column ``text`` (or bytes) of every row to the file ``name`` below ``folder``.

    Files of the same names are replaced; two rows of one name are an error, and
    nothing is written. Returns the written files as ``(name, length)``.
    """
    if not stores.reachable(folder):
        raise ValueError(f"{stores.scheme(folder)}: Dateien dieses Speichers können Tasks nicht schreiben")
    target = stores.full(folder)
    hidden = f"{target}/_temporary-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = f"{hidden}/{task.partitionId()}-{task.taskAttemptId()}"
        store, key = stores.located(own)
        store.create_dir(key, recursive=True)
        count = 0
        for batch in batches:
            notes = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode() if isinstance(text, str) else text or b""
                with store.open_output_stream(f"{key}/{count}") as out:
                    out.write(data)
                notes.append((file_name(name), f"{own}/{count}", len(data)))
                count += 1
            columns = [pa.array([n[at] for n in notes], kind) for at, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "written", "length"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.located(target)
        for batch in batches:
            for name, written in zip(batch.column("name").to_pylist(), batch.column("written").to_pylist(), strict=True):
                final, source = f"{base}/{name}", stores.located(written)[1]
                store.create_dir(final.rpartition("/")[0], recursive=True)
                try:
                    store.move(source, final)
                except OSError:
                    # An attempt before this one has moved it.
                    if store.get_file_info([source])[0].is_file or not store.get_file_info([final])[0].is_file:
                        raise
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("length")], ["name", "length"])

    store, key = stores.located(hidden)
    kind = "binary" if rows.schema["text"].dataType.simpleString() == "binary" else "string"
    try:
        written = stage(
            rows.select(F.col("name").cast("string"), F.col("text").cast(kind))
            .mapInArrow(write, "name string, written string, length long"),
            "text-files",
        )
        twice = written.groupBy("name").count().where("count > 1").head()
        if twice is not None:
            raise ValueError(f"mehrere Texte für {twice['name']}")
        return stage(written.mapInArrow(show, "name string, length long"), "text-files-shown")
    finally:
        if store.get_file_info([key])[0].type != stores.fs.FileType.NotFound:
            store.delete_dir(key)
