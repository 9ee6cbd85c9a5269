"""A growing JSON-lines file as a stream: only complete lines are handed on, a renamed file goes on, a replaced one begins anew."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes that are read for one batch.
BLOCK = 16 << 20


def complete_lines(path: str, start: dict, block: int = BLOCK) -> tuple[list[str], dict]:
    """The complete lines from an offset {inode, byte} on, and the offset behind them. A file with another inode or fewer bytes is
    read from its begin; an absent one has no lines."""
    try:
        with open(path, "rb") as file:
            stat = os.fstat(file.fileno())
            at = start["byte"] if start.get("inode") == stat.st_ino and stat.st_size >= start["byte"] else 0
            data, size = b"", block
            while True:
                file.seek(at)
                data = file.read(size)
                end = data.rfind(b"\n") + 1
                if end or len(data) < size:
                    break
                size *= 2  # a line that is longer than a block
            return data[:end].decode("utf-8", "replace").split("\n")[:-1], {"inode": stat.st_ino, "byte": at + end}
    except FileNotFoundError:
        return [], start


class GrowingFile(DataSource):
    """spark.readStream.format("growing_file").option("path", ...).load(): value."""

    @classmethod
    def name(cls) -> str:
        return "growing_file"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Tail(self.options["path"])


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"inode": -1, "byte": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, end = complete_lines(self.path, start)
        return iter([(x,) for x in lines if x.strip()]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        lines, at, wanted = [], start if start.get("inode") == end["inode"] else {"inode": end["inode"], "byte": 0}, end["byte"]
        while at["byte"] < wanted:
            found, after = complete_lines(self.path, at, wanted - at["byte"])
            if after == at:
                break
            lines, at = lines + found, after
        return iter([(x,) for x in lines if x.strip()])


class TailCount:
    """Counts the lines of a growing file by its new bytes only, and remembers the last id in it."""

    def __init__(self, id_pattern: str) -> None:
        self.pattern, self.offset, self.records, self.last_id = re.compile(id_pattern), {"inode": -1, "byte": 0}, 0, None

    def update(self, path: str) -> int:
        while True:
            lines, after = complete_lines(path, self.offset)
            if after.get("inode") != self.offset.get("inode") or after["byte"] < self.offset["byte"]:
                self.records, self.last_id = 0, None
            self.records += len(lines)
            ids = [m.group() for x in lines[-1:] if (m := self.pattern.search(x))]
            self.last_id = ids[0] if ids else self.last_id
            if after == self.offset or not lines:
                self.offset = after
                return self.records
            self.offset = after
