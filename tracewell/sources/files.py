"""Filesystem access that works for plain paths and for cluster URIs."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def sizes(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of one file, or of all matching files below a folder, sorted."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))


def exists(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def read_range(system: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)
