"""Files that Python workers write to and read from the shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs


def _split(path: str) -> tuple[fs.FileSystem, str]:
    """file:///a, file:/a and /a are local; other schemes are what pyarrow has for them."""
    if m := re.match(r"(?:file:)?(/.*)", path):
        return fs.LocalFileSystem(), re.sub("^/+", "/", m[1])
    return fs.FileSystem.from_uri(path)


def write_file(path: str, write: Callable[[pa.NativeFile], None]) -> int:
    """Write a file under a name of its own and move it into place when whole; gives its bytes."""
    system, place = _split(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{place}.part") as out:
        write(out)
        size = out.tell()
    system.move(f"{place}.part", place)
    return size


def open_file(path: str) -> pa.NativeFile:
    """A file for random access; a local one is mapped, so that reading copies nothing."""
    system, place = _split(path)
    return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
