"""``spark.read.format("ledger")``: the lines of ledgers below a folder, read by byte ranges.

    register(spark)
    lines = spark.read.format("ledger").load(root).where("tenant_id = 'a'")
    events = ledger_events(lines)

The folder has ``<tenant>/<job>/<file>`` with files ending in ``.jsonl`` or ``.txt``; folders may be
named ``key=value``. Equality and IN filters on tenant_id and job_id decide which folders are
listed. A file of any size is cut into ranges of ``split_bytes`` (option, 64 MB); a line belongs to
the range its first byte is in, so a ledger with a third of all lines is read by many tasks.
Option ``errors`` says what becomes of bytes that are no UTF-8: ``ignore`` (dropped, the default) or
``replace``. Blank lines are left out; ``offset`` is a line's first byte, so (file, offset) is the
order of a ledger.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition,
)

SCHEMA = "tenant_id string, job_id string, file string, offset bigint, value string"
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20


@dataclass
class Ranges(InputPartition):
    """Byte ranges (tenant, job, path, start, end) of one task."""

    parts: list


def open_root(root: str):
    """(file system, path) of a folder that Arrow can open."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _name(folder: str) -> str:
    return folder.rsplit("/", 1)[-1].split("=", 1)[-1]


def _lines(stream, start: int, end: int):
    """(offset, bytes) of the lines whose first byte lies in [start, end)."""
    at, held = max(start - 1, 0), []
    stream.seek(at)
    skipping = start > 0  # the byte before the range ends the line that another range owns
    while at < end:
        chunk = stream.read(_CHUNK)
        pieces = chunk.split(b"\n")
        held.append(pieces[0])
        if chunk and len(pieces) == 1:
            continue  # a long line is joined once, when its end is found
        pieces[0] = b"".join(held)
        held = [pieces.pop()] if chunk else []
        for piece in pieces:
            if not skipping and at < end:
                yield at, piece
            skipping = False
            at += len(piece) + 1
        if not chunk:
            return


class LedgerReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.errors = options.get("errors", "ignore")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted = {}

    def pushFilters(self, filters):
        """Folders are chosen here; Spark need not apply these filters again."""
        for item in filters:
            column = getattr(item, "attribute", (None,))[0]
            if column in ("tenant_id", "job_id") and isinstance(item, (EqualTo, EqualNullSafe, In)):
                values = item.value if isinstance(item, In) else (item.value,)
                chosen = {v for v in values if v is not None}
                self.wanted[column] = self.wanted.get(column, chosen) & chosen
            else:
                yield item

    def _open(self):
        return open_root(self.root)

    def _folders(self, files, folder: str, column: str):
        wanted = self.wanted.get(column)
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory and (
                    wanted is None or _name(info.path) in wanted):
                yield info.path

    def partitions(self):
        files, root = self._open()
        found = []
        for tenant in self._folders(files, root, "tenant_id"):
            for job in self._folders(files, tenant, "job_id"):
                found += [(_name(tenant), _name(job), info.path, start,
                           min(start + self.split, info.size))
                          for info in files.get_file_info(fs.FileSelector(job))
                          if info.type == fs.FileType.File
                          and info.path.endswith((".jsonl", ".txt"))
                          for start in range(0, info.size, self.split)]
        tasks, size = [[]], 0
        for part in sorted(found):
            if size + part[4] - part[3] > self.split and tasks[-1]:
                tasks.append([])
                size = 0
            tasks[-1].append(part)
            size += part[4] - part[3]
        return [Ranges(parts) for parts in tasks]

    def read(self, partition):
        files, _ = self._open()
        for tenant, job, path, start, end in partition.parts:
            with files.open_input_file(path) as stream:
                for offset, line in _lines(stream, start, end):
                    text = line.decode("utf-8", self.errors).removesuffix("\r")
                    if text.strip():
                        yield tenant, job, path, offset, text


class LedgerSource(DataSource):
    @classmethod
    def name(cls):
        return "ledger"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LedgerReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
