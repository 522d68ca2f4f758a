"""Files in the shared store: local paths, or any store that pyarrow opens by its URI."""
from __future__ import annotations

import os
import tempfile
import urllib.parse
import uuid


def local(uri: str) -> str | None:
    """The local path of a file: URI or plain path; None for another store."""
    parts = urllib.parse.urlparse(uri)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Output:
    """A file written under a passing name and given its own at the end, so that a repeated task leaves one whole copy."""

    def __init__(self, uri: str):
        self.path = local(uri)
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.stream = open(self.part, "wb")  # noqa: SIM115
        else:
            self.store, self.path = _store(uri)
            self.store.create_dir(os.path.dirname(self.path), recursive=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.stream = self.store.open_output_stream(self.part)

    def close(self) -> None:
        self.stream.close()
        if hasattr(self, "store"):
            self.store.move(self.part, self.path)
        else:
            os.replace(self.part, self.path)


def put(uri: str, data: bytes) -> None:
    out = Output(uri)
    out.stream.write(data)
    out.close()


def opened(uri: str):
    """A stream for reading that can seek."""
    path = local(uri)
    if path is not None:
        return open(path, "rb")
    store, where = _store(uri)
    return store.open_input_file(where)


def listed(uri: str) -> list[tuple[str, int]]:
    """Files below a folder, or the file itself, with their sizes."""
    from pyarrow import fs

    path = local(uri)
    store, where = (fs.LocalFileSystem(), path) if path is not None else _store(uri)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    prefix = uri.rstrip("/")
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted((prefix + f.path[len(where.rstrip("/")):], f.size) for f in found if f.type == fs.FileType.File)


def mapped(uri: str) -> str:
    """A local path of a file; one from another store is copied to the worker's temporary folder."""
    path = local(uri)
    if path is not None:
        return path
    with opened(uri) as f, tempfile.NamedTemporaryFile(delete=False) as out:
        out.write(f.read())
    return out.name
