"""A data source of files and the SHA-256 of their bytes."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Spark's names of schemes and those of Arrow's file systems; others are read by Spark itself.
_SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Files smaller than this together share a task.
SHARED_BYTES = 128 << 20


def readable(path: str) -> bool:
    return path.partition(":/")[0] in _SCHEMES if ":/" in path else True


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, mark, rest = path.partition(":/")
    if not mark or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if mark else path
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:/{rest}")


def sha256_of(files: fs.FileSystem, path: str, chunk_bytes: int) -> str:
    """Digest of a file of any size: one chunk is in memory at a time."""
    digest = hashlib.sha256()
    with files.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(chunk_bytes):
            digest.update(chunk)
    return digest.hexdigest()


@dataclass
class Listed(InputPartition):
    """Files of one task: (path, name, size, time of change)."""

    files: list[tuple[str, str, int, datetime]]


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``; options ``glob`` and ``chunkBytes``.

    Files whose name, or a folder of theirs below the given one, begins with ``_`` or ``.`` are skipped, as Spark does.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, name string, size_bytes bigint, modified_at timestamp, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("chunkBytes", 1 << 20)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, glob: str, chunk_bytes: int) -> None:
        self.path, self.glob, self.chunk_bytes = path, glob, chunk_bytes

    def _listed(self) -> list[fs.FileInfo]:
        files, path = locate(self.path)
        whole = files.get_file_info(path)
        found = [whole] if whole.is_file else []
        if whole.type == fs.FileType.Directory:
            below = len(whole.path.rstrip("/")) + 1
            for info in files.get_file_info(fs.FileSelector(path, recursive=True)):
                parts = info.path[below:].split("/")
                if info.is_file and not any(p.startswith(".") or p.startswith("_") and "=" not in p for p in parts):
                    found.append(info)
        return [info for info in found if fnmatch.fnmatchcase(info.base_name, self.glob)]

    def partitions(self) -> list[InputPartition]:
        parts, held = [], 0
        for info in sorted(self._listed(), key=lambda i: i.path):
            if not parts or held + info.size > SHARED_BYTES:
                parts.append(Listed([]))
                held = 0
            parts[-1].files.append((info.path, info.base_name, info.size, info.mtime or datetime(1970, 1, 1, tzinfo=timezone.utc)))
            held += info.size
        if not parts:
            raise RuntimeError(f"No files found in {self.path}")
        return parts

    def read(self, partition: Listed) -> Iterator[tuple]:
        files, _ = locate(self.path)
        for path, name, size, modified in partition.files:
            yield path, name, size, modified, sha256_of(files, path, self.chunk_bytes)
