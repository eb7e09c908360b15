"""Array files in the shared folder, written and memory-mapped by Python workers."""

from __future__ import annotations

import math
import mmap
import os
import sys
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np

#: Keeps no descriptor for a map; from Python 3.13 on.
_MAP = {"trackfd": False} if sys.version_info >= (3, 13) else {}
#: Maps of local files that stay open in a process: below the 65,530 that Linux allows, or the descriptors that a process may have.
LOCAL_MAPS = 49152 if _MAP else 2048
#: The same of copies of remote files, which take disk.
REMOTE_MAPS = 2048


def local_path(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Writes an array under a name of its own and renames it, so that a repeated or doubled task leaves one whole file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, array)
        os.replace(part, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        np.save(out, array)
    system.move(part, path)


def _read_only(path: str) -> np.ndarray:
    """A file that np.save wrote, mapped; plain, for np.memmap's own indexing is slow, and without a descriptor where Python can do without."""
    with open(path, "rb") as source:
        np.lib.format.read_magic(source)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(source)
        if 0 in shape:
            return np.empty(shape, kind)
        raw = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, **_MAP)
        return np.frombuffer(raw, kind, math.prod(shape), source.tell()).reshape(shape, order="F" if by_column else "C")


@lru_cache(maxsize=LOCAL_MAPS)
def _local(path: str) -> np.ndarray:
    return _read_only(path)


@lru_cache(maxsize=REMOTE_MAPS)
def _copied(uri: str) -> np.ndarray:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(uri)
    handle, path = tempfile.mkstemp(suffix=".npy")
    with os.fdopen(handle, "wb") as out, system.open_input_stream(place) as source:
        while block := source.read(1 << 22):
            out.write(block)
    array = _read_only(path)
    os.remove(path)
    return array


def mapped(uri: str) -> np.ndarray:
    """The array of a file, memory-mapped; so many maps stay open. A file of a remote store is first copied to this worker's
    temporary folder, where its name goes at once and its bytes go with the map."""
    path = local_path(uri)
    return _copied(uri) if path is None else _local(path)
