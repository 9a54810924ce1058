"""Files that Python workers write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid

import numpy as np

OPEN_FILES = 900
HELD_BYTES = 256_000_000
_open: dict[str, dict[str, np.ndarray]] = {}


def store(uri: str):
    """(filesystem, path) of a URI; without a scheme it is a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def create_folder(folder: str) -> None:
    where, path = store(folder)
    where.create_dir(path, recursive=True)


def create(folder: str, name: str):
    """(URI, open stream) of a new file of a name that no other attempt has."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    create_folder(folder)
    where, path = store(uri)
    return uri, where.open_output_stream(path)


def write_new(folder: str, name: str, parts) -> str:
    """Writes the byte strings parts to a file of a name that no other attempt has; its URI. A file that an attempt left unfinished is named by nobody."""
    uri, stream = create(folder, name)
    with stream as out:
        for p in parts:
            out.write(p)
    return uri


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    return write_new(folder, name, (memoryview(np.ascontiguousarray(a)).cast("B") for a in arrays))


def open_arrays(uri: str, n: int, kinds: list[str]) -> list[np.ndarray]:
    """Memory maps of write_arrays' arrays, each of n numbers. What a remote store has, which can't be mapped, is held in memory.

    Maps cost no memory of their own. The arrays used last stay open: OPEN_FILES of them, and HELD_BYTES of those in memory.
    """
    if uri in _open:
        data = _open[uri] = _open.pop(uri)
    else:
        where, path = store(uri)
        if type(where).__name__ == "LocalFileSystem":
            data = np.memmap(path, np.uint8, "r") if n else np.zeros(0, np.uint8)
        else:
            with where.open_input_file(path) as source:
                data = np.frombuffer(source.read(), np.uint8)
        _open[uri] = data
        held = lambda: sum(x.nbytes for x in _open.values() if not isinstance(x, np.memmap))
        while len(_open) > OPEN_FILES or (len(_open) > 1 and held() > HELD_BYTES):
            _open.pop(next(iter(_open)))
    at, out = 0, []
    for kind in kinds:
        end = at + n * np.dtype(kind).itemsize
        out.append(data[at:end].view(kind))
        at = end
    return out


def size_of(uri: str) -> int:
    where, path = store(uri)
    return where.get_file_info(path).size


