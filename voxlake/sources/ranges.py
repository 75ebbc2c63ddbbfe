"""Parts of files: listing, and reads of the ranges that a parser asks for."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs

BLOCK = 1 << 14


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def prefix_of(path: str) -> str:
    """What paths of this file system start with, as Spark's own scans write them."""
    scheme = re.match(r"^([a-z][a-z0-9+.-]*)://", path)
    return f"{scheme[1]}://" if scheme and scheme[1] != "file" else "file:"


def check_folder(root: str) -> None:
    store, at = opened(root)
    kind = store.get_file_info(at).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if kind != fs.FileType.Directory:
        raise NotADirectoryError(root)


def listed(root: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below a folder, sorted; hidden ones are left out, as Spark does."""
    check_folder(root)
    store, at = opened(root)
    lead, base = prefix_of(root), at.rstrip("/") + "/"
    for f in sorted(store.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path):
        below = f.path[len(base) :] if f.path.startswith(base) else f.path
        if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in below.split("/")):
            yield lead + f.path, f.size


class RangeFile:
    """Bytes of an open file by slices, read in blocks; the last block read is kept. `read` counts the bytes fetched."""

    def __init__(self, file, block: int = BLOCK) -> None:
        self.file, self.size, self.block = file, file.size(), block
        self.at, self.held, self.read = 0, b"", 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if not self.at <= start <= stop <= self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(max(stop - start, min(self.block, self.size - start)), start)
            self.read += len(self.held)
        return self.held[start - self.at : stop - self.at]
