"""Random access to files, local or in a store that pyarrow knows."""

from __future__ import annotations

import fnmatch
import re

import pyarrow as pa
from pyarrow import fs


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][\w+.-]*://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^/+", "/", path.removeprefix("file:"))


def open_input(path: str) -> pa.NativeFile:
    system, place = _system(path)
    return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)


def list_files(path: str, suffixes: tuple[str, ...] = (".sav", ".zsav")) -> list[str]:
    """path itself if it is a file; the matching files, in name order, of a folder or a pattern."""
    system, place = _system(path)
    prefix = "" if isinstance(system, fs.LocalFileSystem) else path[: len(path) - len(place)] if path.endswith(place) else ""
    if re.search(r"[*?\[]", place):
        folder = re.split(r"[*?\[]", place)[0].rpartition("/")[0] or "/"
        infos = system.get_file_info(fs.FileSelector(folder, recursive=True))
        return sorted(prefix + i.path for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.path, place))
    info = system.get_file_info(place)
    if info.type == fs.FileType.Directory:
        infos = system.get_file_info(fs.FileSelector(place, recursive=True))
        return sorted(prefix + i.path for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(suffixes))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]
