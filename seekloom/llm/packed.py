"""Sorted arrays on the way between tasks, and arrays that workers map into memory.

Tasks send numbers by hash range as compressed blocks; a range is merged once and
stored in the shared folder as a file under its final name. Workers map such files;
where the folder is no local path, the first worker of a host copies a file, and the
others of that host map the same copy.
"""

from __future__ import annotations

import contextlib
import ctypes
import fcntl
import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of equal significance side by side, which packs small numbers and small gaps well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; names ending in _sorted are stored as gaps."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = {}
    for name, a in arrays.items():
        gaps = np.diff(a, prepend=a.dtype.type(0)) if name.endswith("_sorted") else a
        out[name] = (str(a.dtype), squeeze.compress(_planes(gaps).tobytes()))
    return pickle.dumps(out)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, body) in pickle.loads(data).items():
        kind = np.dtype(kind)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        a = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
        out[name] = np.cumsum(a, dtype=kind) if name.endswith("_sorted") else a
    return out


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) of sorted 64-bit keys, by their top bits."""
    if not bits:
        if len(keys):
            yield 0, slice(0, len(keys))
        return
    bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for part in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        yield part, slice(bounds[part], bounds[part + 1])


def store(folder: str, name: str, a: np.ndarray) -> None:
    """Write an array under a temporary name, then move it: a repeated task leaves one whole file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(np.ascontiguousarray(a).data)
    try:
        fs.move(part, f"{root}/{name}")
    except OSError:  # some stores do not replace; the file there is the same
        if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
            raise
        fs.delete_file(part)


#: Files that a worker maps at once; a system allows some 65,000.
MOST_MAPS = 20_000
_open: dict[tuple[str, str], np.ndarray] = {}


def _local(fs, folder: str, path: str, name: str) -> str:
    """This host's copy of a stored file, made once under a lock."""
    own = os.path.join(tempfile.gettempdir(), f"seekloom-map-{os.getuid()}", hashlib.sha256(folder.encode()).hexdigest()[:32])
    os.makedirs(own, exist_ok=True)
    copy = os.path.join(own, name)
    if not os.path.exists(copy):
        with open(f"{copy}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(copy) and fs.get_file_info(path).type == pafs.FileType.File:
                pafs.copy_files(path, f"{copy}.part", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                os.replace(f"{copy}.part", copy)
    return copy


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A stored array, mapped; empty if there is none. Arrays of one folder stay open in a worker."""
    key = (folder, name)
    if key not in _open:
        if len(_open) >= MOST_MAPS or any(f != folder for f, _ in _open):
            _open.clear()
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/{name}"
        if not isinstance(fs, pafs.LocalFileSystem):
            path = _local(fs, folder, path, name)
        there = os.path.exists(path) and os.path.getsize(path)
        _open[key] = np.memmap(path, np.dtype(kind), "r") if there else np.empty(0, kind)
    return _open[key]


def tidy() -> None:
    """Give memory that a task has freed back to the system, as workers are used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
