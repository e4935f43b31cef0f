"""A sink that writes each row to the file that its key names, all of them or none.

``register(spark)``, then ``df.write.format("keyed_files").option("path", folder)``
with columns key and value (string or binary), in mode append (files of other keys
stay, those of the same keys are replaced) or overwrite (only the new ones stay).
Tasks write below a folder of the job's own; when all are done, files are moved to
their places, and the job's folder goes away. A task that fails and is run again
writes to another folder, whose files alone are moved; a job that fails moves none and
removes its folder (a task that is being killed meanwhile may write there once
more: below ``_pending``, where no key can point).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = "_pending"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI, or of a local path."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def checked(key: str | None) -> str:
    """A key is a relative path without empty segments, dots or the name of the pending folder."""
    segments = (key or "").split("/")
    if any(s in ("", ".", "..") for s in segments) or segments[0] == PENDING or "\0" in (key or ""):
        raise ValueError(f"not the key of a file: {key!r}")
    return key


@dataclass
class Written(WriterCommitMessage):
    """Keys that a task wrote below its folder."""

    folder: str
    keys: list[str]


class KeyedWriter(DataSourceWriter):
    def __init__(self, path: str, places: tuple[int, int], overwrite: bool):
        self.path, self.places, self.overwrite = path.rstrip("/"), places, overwrite
        self.job = f"{PENDING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.path)
        folder, keys = f"{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            key, value = checked(row[self.places[0]]), row[self.places[1]]
            at = f"{root}/{folder}/{key}"
            files.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(at) as out:
                out.write(value.encode() if isinstance(value, str) else bytes(value or b""))
            keys.append(key)
        return Written(folder, keys)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        done = [m for m in messages if m is not None]
        keys = [k for m in done for k in m.keys]
        if len(set(keys)) < len(keys):
            self.abort(messages)
            raise ValueError("rows that repeat a key")
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for x in files.get_file_info(pafs.FileSelector(root)):
                if x.base_name != PENDING:
                    (files.delete_dir if x.type == pafs.FileType.Directory else files.delete_file)(x.path)

        def move(at: tuple[str, str]) -> None:
            folder, key = at
            place = f"{root}/{key}"
            files.create_dir(place.rsplit("/", 1)[0], recursive=True)
            if not isinstance(files, pafs.LocalFileSystem) and files.get_file_info(place).type == pafs.FileType.File:
                files.delete_file(place)  # some file systems don't replace
            files.move(f"{root}/{folder}/{key}", place)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, ((m.folder, k) for m in done for k in m.keys)))
        self._leave(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._leave(*opened(self.path))

    def _leave(self, files: pafs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")
        at = f"{root}/{PENDING}"
        if files.get_file_info(at).type == pafs.FileType.Directory and not files.get_file_info(pafs.FileSelector(at)):
            files.delete_dir(at)  # no other job is at work


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        names = schema.fieldNames()
        return KeyedWriter(self.options["path"], (names.index("key"), names.index("value")), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyedFiles)


def write_keyed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``rows(key, value)`` to files below ``path``."""
    register(rows.sparkSession)
    rows.select("key", "value").write.format("keyed_files").mode(mode).option("path", path).save()
