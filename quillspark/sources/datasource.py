"""Data sources of Spark's own kind: workbooks to read, a sheet a partition, and one named file per work to write, all or none.

Both open paths with Arrow's file systems (local and shared folders, hdfs, s3, gs), in the tasks that read or write.
"""

from __future__ import annotations

import functools
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://?/?", path) else (fs.LocalFileSystem(), path)


def files_in(path: str) -> list[str]:
    """A workbook's own path, or those of the workbooks in a folder."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inner)) if x.extension == "xlsx" and not x.base_name.startswith(("~", ".")))
    return [f"{path.rstrip('/')}/{name}" for name in names]


def sheets_of(book: zipfile.ZipFile) -> list[str]:
    names = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return sorted(names, key=lambda n: int(re.search(r"\d+", n)[0]))


def rows_of(book: zipfile.ZipFile, sheet: str) -> Iterator[dict[int, str | None]]:
    """The cells of each row by column, one row held at a time."""
    texts: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, item in ElementTree.iterparse(f):
                if item.tag == f"{SHEET}si":
                    texts.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
                    item.clear()
    with book.open(sheet) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{SHEET}row":
                continue
            cells: dict[int, str | None] = {}
            for place, c in enumerate(row.iter(f"{SHEET}c")):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else place
                value = c.findtext(f"{SHEET}v")
                if c.get("t") == "s" and value is not None:
                    value = texts[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                cells[at] = value
            row.clear()
            yield cells


@dataclass
class Sheet(InputPartition):
    path: str
    name: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, every: bool, columns: list[str]) -> None:
        self.path, self.every, self.columns = path, every, columns

    def partitions(self) -> list[Sheet]:
        out = []
        for path in files_in(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as book:
                names = sheets_of(book)
            out += [Sheet(path, n) for n in (names if self.every else names[:1])]
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        system, inner = opened(partition.path)
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as book:
            rows = rows_of(book, partition.name)
            header = {name: at for at, name in sorted(next(rows, {}).items(), reverse=True) if name}
            for cells in rows:
                yield tuple(cells.get(header.get(c, -1)) for c in self.columns)


class Workbooks(DataSource):
    """format("workbook"): .xlsx files, strings under the first row's names; option sheets: first (as it is) or all, by name of column.

    Without a schema the first sheet's header is it.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        for path in files_in(self.options["path"]):
            system, inner = opened(path)
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as book:
                for sheet in sheets_of(book):
                    if first := next(rows_of(book, sheet), None):
                        return StructType([StructField(name, StringType()) for _, name in sorted(first.items()) if name])
        raise ValueError(f"no rows in {self.options['path']}")

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheets", "first") == "all", schema.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorksWriter(DataSourceWriter):
    """Tasks write under a folder of the job's own; only the commit makes it, or what is in it, the target's."""

    def __init__(self, path: str, overwrite: bool, archive: bool, suffix: str) -> None:
        self.path, self.overwrite, self.archive, self.suffix = path.rstrip("/"), overwrite, archive, suffix
        self.staged = f"{self.path}.writing-{uuid.uuid4().hex}"
        # made here on the driver only: what still runs when the job is aborted finds no folder to write to
        system, staged = opened(self.staged)
        system.create_dir(staged)

    def write(self, rows: Iterator[Row]) -> Written:
        system, staged = opened(self.staged)
        attempt, names = uuid.uuid4().hex, []
        if self.archive:
            part = f"works-{TaskContext.get().partitionId():05d}.zip"
            own = None
            for row in rows:
                if own is None:  # a task without works leaves no archive
                    stream = system.open_output_stream(f"{staged}/.{attempt}")
                    own = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                own.writestr(self.named(row[0]), row[1] or "")
            if own is not None:
                own.close(), stream.close()
                system.move(f"{staged}/.{attempt}", f"{staged}/{part}")
                names.append(part)
            return Written(names)
        for row in rows:
            name = self.named(row[0])
            with system.open_output_stream(f"{staged}/.{attempt}") as f:
                f.write(f"{row[1] or ''}\n".encode())  # Spark's readers pass over files of no bytes
            system.move(f"{staged}/.{attempt}", f"{staged}/{name}")
            names.append(name)
        return Written(names)

    def named(self, work) -> str:
        name = f"{work}{self.suffix}"
        if "/" in name or "\0" in name or name.startswith("."):
            raise ValueError(f"{work!r} can't be the name of a file")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, staged = opened(self.staged)
        path = opened(self.path)[1]
        names = [name for m in messages if m is not None for name in m.names]
        if doubled := len(names) - len(set(names)):
            self.abort(messages)
            raise ValueError(f"{doubled} works have the name of another")
        left = {x.base_name for x in system.get_file_info(fs.FileSelector(staged))} - set(names)
        for name in left:  # of attempts that were lost
            system.delete_file(f"{staged}/{name}")
        if self.overwrite or system.get_file_info(path).type == fs.FileType.NotFound:
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_dir(path)
            system.move(staged, path)
        else:
            for name in names:
                system.move(f"{staged}/{name}", f"{path}/{name}")
            system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, staged = opened(self.staged)
        for _ in range(20):  # a task that ends just now may add a file
            if system.get_file_info(staged).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(staged)
            except OSError:
                time.sleep(0.1)


class Works(DataSource):
    """format("works"): a file {work}_cleaned.txt for each row of work and text, with a line feed at its end; option archive: one archive a task instead, texts as they are.

    The whole output appears at once, or not at all: overwrite replaces the folder, append adds files to it.
    """

    @classmethod
    def name(cls) -> str:
        return "works"

    def writer(self, schema: StructType, overwrite: bool) -> WorksWriter:
        if len(schema) != 2:
            raise ValueError("two columns are written: the work's name and its text")
        return WorksWriter(self.options["path"], overwrite, self.options.get("archive", "false") == "true", self.options.get("suffix", "_cleaned.txt"))


def register_sources(spark: SparkSession) -> None:
    for source in (Workbooks, Works):
        spark.dataSource.register(source)
