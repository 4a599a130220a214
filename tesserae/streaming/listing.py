"""A stream of changes in a folder: files that were added, edited or removed since the last batch.

Spark's own file source announces a path once.  Here an offset numbers a listing of the folder (path,
time of change, length), kept below ``state``; a batch is the difference of two listings, and only
the files that differ are read, by the executors.  A query that is started again goes on from the
listing of its checkpoint, so changes made meanwhile are found.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "event string, path string, modified timestamp, length long, content binary"
#: Files, and bytes, that one task of a batch reads at most; a longer file is read alone.
TASK_FILES, TASK_BYTES = 1000, 64 << 20


@dataclass
class Changed(InputPartition):
    """``(event, path, nanoseconds, length)`` of some files."""

    root: str
    files: list

    def __init__(self, root: str, files: list):
        super().__init__(None)
        self.root, self.files = root, files


def difference(old: dict, new: dict) -> list[tuple[str, str, int, int]]:
    """``(event, path, nanoseconds, length)`` of each path that two listings show differently."""
    out = [("added" if p not in old else "edited", p, *new[p]) for p in new if new[p] != old.get(p)]
    return sorted(out + [("removed", p, *old[p]) for p in old if p not in new], key=lambda x: x[1])


def dealt(files: list, most: int = TASK_FILES, size: int = TASK_BYTES) -> list[list]:
    """Files in groups for tasks."""
    out, held, n = [], [], 0
    for f in files:
        own = 0 if f[0] == "removed" else f[3]
        if held and (len(held) == most or own and n + own > size):
            out, held, n = [*out, held], [], 0
        held, n = [*held, f], n + own
    return [*out, held] if held else out


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["root"].rstrip("/"), options.get("glob", "*")
        self.state = options["state"].rstrip("/")

    def _open(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def _numbers(self) -> list[int]:
        where, path = self._open(self.state)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def _saved(self, number: int) -> dict:
        if not number:
            return {}
        where, path = self._open(self.state)
        with where.open_input_stream(f"{path}/{number}.json") as f:
            return {p: tuple(x) for p, x in json.loads(f.read()).items()}

    def _listing(self) -> dict:
        where, path = self._open(self.root)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.path[len(path) :].lstrip("/"): (f.mtime_ns, f.size) for f in found if f.is_file and not f.base_name.startswith(".") and fnmatch(f.base_name, self.glob)}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        number, now = max(self._numbers(), default=0), self._listing()
        if now != self._saved(number):
            number += 1
            where, path = self._open(self.state)
            where.create_dir(path)
            with where.open_output_stream(f"{path}/{number}.part") as f:
                f.write(json.dumps(now).encode())
            where.move(f"{path}/{number}.part", f"{path}/{number}.json")  # a listing is there as a whole or not at all
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        changed = difference(self._saved(start["listing"]), self._saved(end["listing"]))
        return [Changed(self.root, files) for files in dealt(changed)]

    def read(self, partition: Changed) -> Iterator[tuple]:
        where, path = self._open(partition.root)
        for event, name, ns, length in partition.files:
            content = None
            if event != "removed":
                try:
                    with where.open_input_stream(f"{path}/{name}") as f:
                        content = f.read()
                except FileNotFoundError:  # removed meanwhile: the next listing says so
                    continue
            yield event, name, datetime.fromtimestamp(ns / 1e9, UTC).replace(tzinfo=None), length, content

    def commit(self, end: dict) -> None:
        """Listings before the last committed one are not asked for again."""
        where, path = self._open(self.state)
        for n in self._numbers():
            if n < end["listing"]:
                where.delete_file(f"{path}/{n}.json")


class FolderChanges(DataSource):
    """Options: ``root``, ``glob`` of file names, ``state`` for listings; both folders by a path that all machines know."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def folder_changes(spark: SparkSession, root: str, state: str, glob: str = "*"):
    """``event, path, modified, length, content`` as a stream."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("root", root).option("state", state).option("glob", glob).load()
