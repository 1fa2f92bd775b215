"""A streaming source of lines that are appended to log files.

Spark's own file stream takes a file as final once it is listed; this one remembers, for
each file, how far it was read and a fingerprint of what came before. A file that grew is
read on from there, one that was replaced from its beginning; a line without its line
feed waits. Register with ``spark.dataSource.register(SessionLines)``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillstone.functions.fingerprint import TAIL, fnv1a

SCHEMA = "adapter string, source_key string, source_path string, start_byte long, raw_line string"


def discover(root: str, depth: int | None = None) -> list[str]:
    """``*.jsonl`` files in any case below a folder, sorted, without links; with ``depth`` only those exactly so many folders down."""
    out = []
    for folder, subfolders, names in os.walk(root):
        subfolders[:] = sorted(s for s in subfolders if not os.path.islink(os.path.join(folder, s)))
        below = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        if depth is None or below == depth:
            out += [os.path.join(folder, n) for n in names if n.lower().endswith(".jsonl") and not os.path.islink(os.path.join(folder, n))]
    return sorted(out)


def notes(root: str) -> list[str]:
    """``memory/*.md`` anywhere below a folder, sorted."""
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) if os.path.basename(d) == "memory" for n in names if n.lower().endswith(".md"))


def fingerprint(path: str, offset: int) -> str:
    with open(path, "rb") as f:
        f.seek(max(0, offset - TAIL))
        return f"{int(fnv1a([f.read(min(offset, TAIL))])[0]):016x}"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _lines(adapter: str, part: _Range) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        f.seek(part.start)
        at = part.start
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            text = line[:-1].decode("utf-8", "replace")
            if text.strip():
                yield adapter, part.path, part.path, at, text
            at += len(line)


def _complete(path: str, start: int, size: int, most: int) -> int:
    """The end of the last complete line, at most ``most`` bytes on; of a longer line its own end."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(min(size - start, most))
        cut = data.rfind(b"\n")
        if cut >= 0 or start + len(data) >= size:
            return start + cut + 1
        rest = f.readline()
        return start + len(data) + len(rest) if rest.endswith(b"\n") else start


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str, adapter: str, most: int) -> None:
        self.root, self.adapter, self.most = root, adapter, most
        self._last: dict = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files = {}
        for path in discover(self.root):
            size, old = os.path.getsize(path), self._last.get(path)
            start = 0
            if old and old["end"] <= size and fingerprint(path, old["end"]) == old["fingerprint"]:
                start = old["end"]
            end = _complete(path, start, size, self.most)
            files[path] = {"start": start, "end": end, "fingerprint": fingerprint(path, end)}
        self._last = files
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, f in new.items():
            before = old.get(path, {"end": 0})["end"]
            begin = before if before <= f["end"] and (before == 0 or fingerprint(path, before) == old[path]["fingerprint"]) else 0
            if begin < f["end"]:
                out.append(_Range(path, begin, f["end"]))
        return out

    def commit(self, end: dict) -> None:
        self._last = json.loads(end["files"])

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _lines(self.adapter, partition)


class _Batch(DataSourceReader):
    def __init__(self, root: str, adapter: str) -> None:
        self.root, self.adapter = root, adapter

    def partitions(self) -> list[_Range]:
        return [_Range(p, 0, os.path.getsize(p)) for p in discover(self.root)] or [_Range(os.devnull, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return _lines(self.adapter, partition)


class SessionLines(DataSource):
    """Options: ``path``, ``adapter`` and, for streams, ``maxBytesPerFile`` of a batch."""

    @classmethod
    def name(cls) -> str:
        return "session_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], self.options.get("adapter", "log_a"))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], self.options.get("adapter", "log_a"), int(self.options.get("maxBytesPerFile", str(64 << 20))))
