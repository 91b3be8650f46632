"""Files that tasks read and write themselves, by any path that Arrow's file systems know (file, hdfs, s3, gs)."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def read_bytes(path: str) -> bytes:
    files, place = opened(path)
    with files.open_input_stream(place) as stream:
        return stream.read()


def write_bytes(path: str, data: bytes) -> None:
    """A whole file or none: it's written under a hidden name, then moved."""
    files, place = opened(path)
    folder, name = place.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(hidden) as stream:
        stream.write(data)
    files.move(hidden, place)


def exists(path: str) -> bool:
    files, place = opened(path)
    return files.get_file_info(place).type != fs.FileType.NotFound
