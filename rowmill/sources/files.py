"""Files by path or URI, through Arrow's file systems."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        path = path if "://" in path else "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str, suffix: str = ".avro") -> list[fs.FileInfo]:
    """A file, or the visible files below a folder with the suffix, by path. Names that start with _ or . are hidden."""
    system, at = open_fs(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type != fs.FileType.Directory:
        return []
    out = system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda p: not any(part[:1] in "._" for part in p[len(at) :].strip("/").split("/"))
    return sorted((f for f in out if f.type == fs.FileType.File and f.path.endswith(suffix) and shown(f.path)), key=lambda f: f.path)


def open_input(root: str, path: str) -> BinaryIO:
    return open_fs(root)[0].open_input_file(path)
