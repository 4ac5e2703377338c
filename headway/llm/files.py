"""Files in the shared folder, written and read inside tasks; any store that pyarrow.fs opens will do."""

from __future__ import annotations

import uuid


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(folder: str, name: str, body: bytes) -> str:
    """Write under another name, then move: a task that runs twice leaves one whole file."""
    store, path = _fs(folder)
    store.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(body)
    store.move(tmp, f"{path}/{name}")
    return f"{folder}/{name}"


def opened(uri: str):
    """A file with seek and read, for range reads."""
    store, path = _fs(uri)
    return store.open_input_file(path)


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    with opened(uri) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def remove(folder: str) -> None:
    """Delete a folder that no later job reads."""
    store, path = _fs(folder)
    store.delete_dir(path)
