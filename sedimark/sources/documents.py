"""Files as a Spark data source: spark.read.format("sedimark_documents") and spark.readStream of the same, after register(spark).

Options: path (a folder or file that the driver and all executors see under one name, such as a shared mount), recursive (true), partition_bytes (64 MiB), settled
(2 seconds). Rows: source_id, path, format, block_ord, locator, text and error, as extract() gives them; a file that a gate refuses has one row with its error. Links are not followed. A file
whose content another one repeats is read too: distinct contents are a matter of scan().

The driver lists names, sizes and times only. Tasks get files of about partition_bytes together; filters on path (equal, in, starting with) leave files unread, those on format leave
files of known suffixes of other formats unread. A stream's offset is the time and name of the last file that it has taken, and files are taken once they have been unchanged for the settled time, so a restarted
query reads only what is newer.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .formats import SUFFIXES
from .readers import gate, read_blocks

SCHEMA = "source_id string, path string, format string, block_ord bigint, locator string, text string, error string"
NAME = "sedimark_documents"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def listed(path: str, recursive: bool) -> list[tuple[int, str, int]]:
    """(modification time in nanoseconds, path, size) of files, oldest first."""
    out = []
    todo = [path]
    while todo:
        here = todo.pop()
        if os.path.islink(here):
            continue
        if os.path.isdir(here):
            todo += [e.path for e in os.scandir(here) if recursive or not e.is_dir()]
        elif os.path.isfile(here):
            s = os.stat(here)
            out.append((s.st_mtime_ns, here, s.st_size))
    return sorted(out)


def dealt(files: list[tuple[int, str, int]], limit: int) -> list[Files]:
    """Files in parts of at most limit bytes, unless one file is larger; an empty file counts as one byte."""
    parts: list[list[str]] = []
    held = limit
    for _, path, size in files:
        if held + max(1, size) > limit:
            parts.append([])
            held = 0
        parts[-1].append(path)
        held += max(1, size)
    return [Files(tuple(p)) for p in parts]


def rows_of(path: str) -> Iterator[tuple]:
    """The rows of one file."""

    def content() -> bytes:
        with open(path, "rb") as f:
            return f.read()

    try:
        kind, _, error = gate(path, os.path.getsize(path), content)
        data = b"" if error else content()
    except OSError:
        kind, error, data = None, "unreadable", b""
    if error:
        yield None, path, kind, 1, None, None, error
        return
    found, error = read_blocks(kind, data)
    source = hashlib.sha256(data).hexdigest()[:12]
    for n, (locator, text) in enumerate(found, 1):
        yield source, path, kind, n, locator, text, error


class _Settings:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError(f"{NAME}: option path is missing")
        self.path = options["path"].removeprefix("file://")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.limit = int(options.get("partition_bytes", 64 << 20))
        self.settled = float(options.get("settled", 2))


class DocumentsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.settings, self.tests = _Settings(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what spares files; all filters are left to Spark as well, as suffixes do not prove a format."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "path":
                if isinstance(f, EqualTo):
                    self.tests.append(lambda p, v=f.value: p == v)
                elif isinstance(f, In):
                    self.tests.append(lambda p, v=frozenset(f.value): p in v)
                elif isinstance(f, StringStartsWith):
                    self.tests.append(lambda p, v=f.value: p.startswith(v))
            elif column == "format" and isinstance(f, (EqualTo, In)):
                wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                # the content decides, so a suffix only rules out what no content can make it: text stays text of its suffix
                texts = {"txt", "md", "html"}
                self.tests.append(lambda p, w=wanted, t=texts: (k := SUFFIXES.get(p.rsplit(".", 1)[-1].lower())) is None or k in w or not (k in t and not w - t))
            yield f

    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.settings.path, self.settings.recursive) if all(test(f[1]) for test in self.tests)]
        self.tests = []
        return dealt(files, self.settings.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from rows_of(path)


class DocumentsStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.settings = _Settings(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settings.settled * 1e9)
        files = [f for f in listed(self.settings.path, self.settings.recursive) if f[0] <= until]
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in listed(self.settings.path, self.settings.recursive) if lo < f[:2] <= hi], self.settings.limit)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from rows_of(path)

    def commit(self, end: dict) -> None:
        pass


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentsReader:
        return DocumentsReader(self.options)

    def streamReader(self, schema) -> DocumentsStreamReader:
        return DocumentsStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
