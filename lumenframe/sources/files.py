"""Files of binary formats, by path or URI, for tasks that read byte ranges."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def listed(path: str, *suffixes: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder that end so, in order."""
    system, at = filesystem(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f"{path.rstrip('/')}/{f.path.removeprefix(at).lstrip('/')}", f.size) for f in files if f.is_file and f.path.endswith(suffixes))


def shares(path: str, split_bytes: int, *suffixes: str) -> list[tuple[str, int, int]]:
    """(path, k, n): each file in n shares of some split_bytes."""
    return [(p, k, n) for p, size in listed(path, *suffixes) for n in [max(1, -(-size // split_bytes))] for k in range(n)]


#: Tasks below which files have tasks of their own, and what one task reads at most of several files.
TASKS, PACK_FILES, PACK_BYTES = 64, 64, 32 << 20


def packs(parts: list, sizes: list[int]) -> list[list]:
    """parts in order, in runs: a task for each run, so that tasks are not as many as small files."""
    most, out, room = min(PACK_FILES, max(1, len(parts) // TASKS)), [], 0
    for part, size in zip(parts, sizes, strict=True):
        if not out or len(out[-1]) == most or size > room:
            out.append([])
            room = PACK_BYTES
        out[-1].append(part)
        room -= size
    return out


class Ranges:
    """read(offset, n) and size of a file."""

    def __init__(self, path: str):
        system, at = filesystem(path)
        self._file = system.open_input_file(at)
        self.size = self._file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self._file.read_at(n, offset) if n > 0 else b""


def put(path: str, parts: list[bytes]) -> int:
    """Write a file whole or not at all; its size."""
    system, at = filesystem(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    system.move(part, at)
    return sum(map(len, parts))
