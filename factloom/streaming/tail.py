"""A streaming source that follows files that are appended to.

Spark's file source takes a path once and misses what is appended later.  Here
the offset of the stream is a byte position for each file, so a batch has just
the complete lines between two positions; a last line without its end waits.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what to put before it): of file:, hdfs:, s3:, gs: and other URIs, or of a local path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/"), ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)]


def _matching(pattern: str) -> list[str]:
    """The files that a glob names, part by part; no wildcard crosses a slash."""
    system, inner, prefix = _system(pattern)
    parts = inner.split("/")
    fixed = next((k for k, p in enumerate(parts[:-1]) if any(c in p for c in "*?[")), len(parts) - 1)
    found = [("/".join(parts[:fixed]) or "/", True)]
    for part in parts[fixed:]:
        deeper = []
        for folder, is_folder in found:
            if is_folder:
                listed = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
                deeper += [(i.path, i.type == pafs.FileType.Directory) for i in listed if fnmatch.fnmatchcase(i.base_name, part)]
        found = deeper
    return sorted(prefix + p for p, is_folder in found if not is_folder)


def _open(path: str):
    system, inner, _ = _system(path)
    return system.open_input_file(inner)


class TailReader(DataSourceStreamReader):
    """Option ``path`` is a glob of local paths or URIs; ``max_bytes`` bounds what a batch takes of one file, at least a line."""

    def __init__(self, options: dict):
        self.pattern, self.most = options["path"], int(options.get("max_bytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: _complete(p) for p in _matching(self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path, stop in end.items():
            at = int(start.get(path, 0))
            at = 0 if at > stop else at  # a file that shrank is read anew
            while at < stop:
                cut = stop if stop - at <= self.most else _line_end(path, at + self.most, stop)
                parts.append(FileRange(path, at, cut))
                at = cut
        return parts or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        if not partition.path:
            return
        with _open(partition.path) as f:
            f.seek(partition.start)
            at, held = partition.start, b""
            while at + len(held) < partition.end:
                piece = f.read(min(1 << 20, partition.end - at - len(held)))
                if not piece:  # the file was cut short since
                    break
                held += piece
                lines = held.split(b"\n")
                held = lines.pop()
                for line in lines:
                    text = line.rstrip(b"\r").decode("utf-8", "replace")
                    if text:
                        yield partition.path, at, text
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


def _complete(path: str) -> int:
    """The position after the last line feed."""
    with _open(path) as f:
        at = f.size()
        while at > 0:
            back = max(0, at - 65_536)
            f.seek(back)
            found = f.read(at - back).rfind(b"\n")
            if found >= 0:
                return back + found + 1
            at = back
    return 0


def _line_end(path: str, at: int, stop: int) -> int:
    """The position after the first line feed from ``at`` on."""
    with _open(path) as f:
        f.seek(at)
        while at < stop:
            piece = f.read(min(65_536, stop - at))
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
    return stop


class TailSource(DataSource):
    """Format ``tail``: (path, offset, value) of appended lines; offset is the line's first byte."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


