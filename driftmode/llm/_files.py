"""Files of own formats in the shared folder: whole writes that survive retries, and range reads.

Paths are those of ``spark.checkpoint.dir``, or any URI that pyarrow's file systems open (``file:``,
``hdfs:``, ``s3:``, ``gs:``). A file gets a name of its own for each attempt and only then goes into
the writer's result rows, so a task that runs twice leaves a stray file at worst.
"""

from __future__ import annotations

import functools
import uuid

from pyarrow import fs


@functools.lru_cache(maxsize=32)
def _system(root: str) -> tuple[fs.FileSystem, str]:
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return fs.FileSystem.from_uri(root)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    folder, _, name = uri.rpartition("/")
    system, path = _system(folder)
    return system, f"{path}/{name}"


def new_name(folder: str, prefix: str, suffix: str) -> str:
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    system, path = locate(uri)
    return system.open_output_stream(path, compression=None)


@functools.lru_cache(maxsize=8)
def _opened(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def read_range(uri: str, offset: int, size: int) -> bytes:
    return _opened(uri).read_at(size, offset)


def size_of(uri: str) -> int:
    return _opened(uri).size()
