"""Lines appended to logs that rotate, as a stream in byte ranges.

``readStream.format("log_tail").option("path", "folder/app.log")`` reads every
file of the folder whose name begins with the log's (``app.log``,
``app.log.1``, ``app.log-2024``), on any store that pyarrow opens by address.
A file is known by its first line and not by its name, so one that is renamed
goes on where it was, and one that is cut and written anew under its old name
is a new file. An offset holds how far each file has been read, always up to
the end of a line; what stands behind it waits for its end.

``bytesPerPartition`` (8 MB) parts a batch into tasks, ``bytesPerBatch`` bounds
what one batch takes in (but for the first one after a restart). A file that is
removed before it was read to its end is lost, and a batch that needs it fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIRST, BLOCK = 4096, 1 << 20


def _opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _identity(f) -> str | None:
    """Of the first line, if that is whole (of its first bytes, where it is longer than ``FIRST``)."""
    head = f.read_at(FIRST, 0)
    end = head.find(b"\n")
    return hashlib.sha256(head[: end + 1] if end >= 0 else head).hexdigest()[:32] if end >= 0 or len(head) == FIRST else None


def _last_line_end(f, size: int) -> int:
    """The byte after the last line end."""
    at = size
    while at > 0:
        low = max(0, at - BLOCK)
        found = f.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def _next_line_end(f, at: int, size: int) -> int:
    """The byte after the first line end at or behind ``at - 1``."""
    at = max(0, at - 1)
    while at < size:
        block = f.read_at(min(BLOCK, size - at), at)
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return size


@dataclass(frozen=True)
class Log:
    """All files of a log."""

    path: str

    def files(self) -> dict[str, tuple[str, int]]:
        """Path and size by identity, the oldest first."""
        from pyarrow import fs

        system, path = _opened(self.path)
        folder, _, name = path.rpartition("/")
        infos = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        out: dict[str, tuple[str, int]] = {}
        for info in sorted((i for i in infos if i.is_file and i.base_name.startswith(name)), key=lambda i: (i.mtime_ns or 0, i.base_name)):
            try:
                with system.open_input_file(info.path) as f:
                    key, size = _identity(f), f.size()
            except FileNotFoundError:  # renamed meanwhile: it is met under its other name, now or next time
                continue
            if key is not None and (key not in out or size > out[key][1]):
                out[key] = (info.path, size)
        return out

    def open(self, key: str):
        """The file of this identity, wherever it is by now."""
        for _ in range(3):
            found = self.files().get(key)
            if found is None:
                break
            try:
                f = _opened(self.path)[0].open_input_file(found[0])
            except FileNotFoundError:
                continue
            if _identity(f) == key:
                return f
            f.close()
        raise RuntimeError(f"A file of {self.path} is gone before it was read.")


@dataclass
class Range(InputPartition):
    """Lines that begin from ``low`` on and before ``high``; ``start`` is where the batch begins in the file."""

    key: str
    start: int
    low: int
    high: int
    end: int


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        each, all_ = self.options.get("bytesPerPartition"), self.options.get("bytesPerBatch")
        return _Tail(Log(self.options["path"]), int(each or 8 << 20), int(all_) if all_ else None)


class _Tail(DataSourceStreamReader):
    def __init__(self, log: Log, each: int, most: int | None):
        self.log, self.each, self.most = log, each, most
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        system, left, out = _opened(self.log.path)[0], self.most, {}
        for key, (path, size) in self.log.files().items():
            start = (self.at or {}).get(key, 0)
            try:
                with system.open_input_file(path) as f:
                    if _identity(f) != key:
                        raise FileNotFoundError
                    end = max(start, _last_line_end(f, size))
                    if left is not None and self.at is not None:
                        end = min(end, _next_line_end(f, start + left, size) if left > 0 else start)
                        left = max(0, left - (end - start))
            except FileNotFoundError:
                end = start
            if end:
                out[key] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        out = []
        for key, high in end.items():
            low = start.get(key, 0)
            out += [Range(key, low, at, min(at + self.each, high), high) for at in range(low, high, self.each)]
        return out

    def commit(self, end: dict) -> None:
        self.at = dict(end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with self.log.open(partition.key) as f:
            at = partition.low if partition.low == partition.start else _next_line_end(f, partition.low, partition.end)
            held = b""
            began = at
            while began < partition.high:
                block = f.read_at(min(BLOCK, partition.end - at), at)
                at += len(block)
                held += block
                lines = held.split(b"\n")
                held = lines.pop()
                values, places = [], []
                for line in lines:
                    if began >= partition.high:
                        break
                    if line.strip():
                        values.append(line.decode("utf-8", "replace").rstrip("\r"))
                        places.append(began)
                    began += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([partition.key] * len(values)), pa.array(places, pa.int64())], ["value", "file", "at"])
                if not block:
                    break
