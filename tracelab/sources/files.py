"""Files below a path, for the Python data sources: any store that
``pyarrow.fs`` opens (local and shared folders, HDFS, object stores)."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path``, hidden ones left out, in order of their names."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))

    def shown(p: str) -> bool:
        return not any(part.startswith(("_", ".")) for part in p[len(root) :].strip("/").split("/"))

    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f.path) and f.path.endswith(suffix))
