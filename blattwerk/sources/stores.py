"""Files as tasks see them: listing, reading and writing through Arrow's file systems.

Local folders, S3, GCS, ABFS and HDFS are opened by the tasks themselves, so the
driver holds neither names nor content. Other stores are left to Spark's readers.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs

SCHEMES = ("file", "s3", "s3a", "gs", "gcs", "abfs", "abfss", "hdfs")
_PATH = re.compile(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(/?.*)", re.DOTALL)
_ARROW_NAMES = {"s3a": "s3", "gcs": "gs", "abfss": "abfs"}


def scheme(path: str) -> str:
    return _PATH.fullmatch(path)[1] or "file"


def reachable(path: str) -> bool:
    """Whether tasks can open files of this store."""
    return scheme(path) in SCHEMES


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path, and the path in it."""
    _, host, key = _PATH.fullmatch(path).groups()
    name = scheme(path)
    if name == "file":
        return fs.LocalFileSystem(), key
    store, base = fs.FileSystem.from_uri(f"{_ARROW_NAMES.get(name, name)}://{host or ''}/")
    return store, base.rstrip("/") + key


class _Ranges(io.RawIOBase):
    """A file of a store as Python's own libraries expect one: steps before its start are an ``OSError``."""

    def __init__(self, path: str) -> None:
        store, key = located(path)
        self.file = store.open_input_file(key)
        self.length = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.length}[whence]
        if place < 0:
            raise OSError("Stelle vor dem Anfang der Datei")
        return self.file.seek(min(place, self.length))

    def readinto(self, buffer: memoryview) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str) -> BinaryIO:
    """A file for reads of ranges at any place."""
    return io.BufferedReader(_Ranges(path), 1 << 16)


def full(folder: str) -> str:
    """A folder's path as Spark writes it: with a scheme and without a slash at its end."""
    folder = folder.rstrip("/") or "/"
    return folder if _PATH.fullmatch(folder)[1] else f"file:{os.path.abspath(folder)}"


def entries(folder: str) -> Iterator[tuple[str, bool, int, object]]:
    """(path, is a folder, length, time of change) of what a folder holds.

    Local folders are read on as rows are taken. Folders behind links are left out,
    as are ones that may not be read.
    """
    store, key = located(folder)
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(key) as found:
                for entry in found:
                    if entry.is_dir(follow_symlinks=False):
                        yield f"{folder}/{entry.name}", True, 0, None
                    elif entry.is_file():
                        state = entry.stat()
                        yield f"{folder}/{entry.name}", False, state.st_size, int(state.st_mtime * 1_000_000)
        except PermissionError:
            return
        return
    for info in store.get_file_info(fs.FileSelector(key)):
        time = None if info.mtime_ns is None else info.mtime_ns // 1000
        yield f"{folder}/{info.base_name}", info.type == fs.FileType.Directory, info.size or 0, time


LISTED = pa.schema([
    ("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])


def listed(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """What the folders in column ``path`` hold, in batches of at most ``most`` rows."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), LISTED)], schema=LISTED)

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            for row in entries(folder):
                rows.append(row)
                if len(rows) == most:
                    yield out()
                    rows.clear()
    if rows:
        yield out()


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content), one file at a time."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, key = located(path)
            with store.open_input_file(key) as file:
                content = file.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])
