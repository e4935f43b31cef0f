"""Files that tasks write to and read from the shared folder.

A task writes under a name of its own and reports it in its result rows, so the
files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs as pafs
from pyspark import TaskContext


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def create(folder: str, ending: str):
    """A new file's URI and output stream."""
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    name = f"p{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{ending}"
    return f"{folder}/{name}", files.open_output_stream(f"{path}/{name}")


def stream(uri: str):
    files, path = opened(uri)
    return files.open_input_stream(path)
