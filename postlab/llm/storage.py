"""Files in the folder all machines share, on any filesystem that Spark and pyarrow both reach."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(parts.path)
    return fs.FileSystem.from_uri(uri)


def put(uri: str, pieces) -> int:
    """Write byte pieces under a private name, then move the file into place: a task that is run again, or twice
    at a time, leaves one whole file. Returns its size."""
    store, path = opened(uri)
    folder, size = path.rpartition("/")[0], 0
    store.create_dir(folder, recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(private) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    store.move(private, path)
    return size


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def size_of(uri: str) -> int:
    store, path = opened(uri)
    return store.get_file_info(path).size
