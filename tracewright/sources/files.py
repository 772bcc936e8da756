"""Single-file sinks by tasks: every task writes a part, and the commit joins the parts.

XML and SQLite logs are single files. Their rows do not pass the driver: tasks write parts
into a folder beside the file, and the commit appends the XML parts, which are compressed, or
attaches the SQLite parts and copies their tables, into a new file that then takes the name.
A part is deleted once it is copied, so the disk holds little more than the file. An XML
file whose name ends in .gz is its parts as they are, one after the other. If a
task fails for good, the folder goes and no file appears; an earlier file stays as it was.
Parts of tasks that ran twice are left out, as only committed parts are named. The path
must be one that driver and executors mount alike.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def local_path(path: str) -> str:
    """A path of a mounted file system; others, which files cannot be opened on, are an error."""
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in plain or plain.split("/", 1)[0].endswith(":"):
        raise ValueError(f"{path!r} is not on a mounted file system")
    return plain


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = local_path(path)
        name = os.path.basename(self.path)
        self.folder = os.path.join(os.path.dirname(os.path.abspath(self.path)), f".{name}-{uuid.uuid4().hex}")

    def _part(self) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        number = TaskContext.get().partitionId()
        return Part(number, os.path.join(self.folder, f"{number:08}-{uuid.uuid4().hex}"))

    def _parts(self, messages: list) -> list[str]:
        return [m.path for m in sorted((m for m in messages if m is not None), key=lambda m: m.number)]

    def _finish(self, made: str) -> None:
        os.replace(made, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class TextWriter(_Writer):
    """Lines of one column, in the order of the partitions; compressed if the name ends in .gz."""

    def write(self, iterator: Iterator) -> Part:
        part = self._part()
        with gzip.open(part.path, "wt", 1, encoding="utf-8", newline="\n") as out:
            for row in iterator:
                out.write(row[0])
                out.write("\n")
        return part

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        made = os.path.join(self.folder, "whole")
        with open(made, "wb") as out:
            for path in self._parts(messages):
                with open(path, "rb") if self.path.endswith(".gz") else gzip.open(path, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
                os.unlink(path)
        self._finish(made)


class TablesWriter(_Writer):
    """Rows (table, values) into the tables that the option ``tables`` lists with their columns, in the order of the partitions."""

    def __init__(self, path: str, tables: dict[str, list[str]]) -> None:
        super().__init__(path)
        self.tables = tables

    def _create(self, db: sqlite3.Connection) -> None:
        for table, columns in self.tables.items():
            db.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(c)} TEXT' for c in columns)})")

    def write(self, iterator: Iterator) -> Part:
        part = self._part()
        db = sqlite3.connect(part.path, isolation_level=None)
        try:
            self._create(db)
            db.execute("BEGIN")
            for table, rows in groupby(iterator, key=lambda r: r[0]):
                marks = ", ".join("?" * len(self.tables[table]))
                db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", (list(r[1]) for r in rows))
            db.execute("COMMIT")
        finally:
            db.close()
        return part

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        made = os.path.join(self.folder, "whole")
        db = sqlite3.connect(made, isolation_level=None)
        try:
            self._create(db)
            for path in self._parts(messages):
                db.execute("ATTACH ? AS part", (path,))
                db.execute("BEGIN")
                for table in self.tables:
                    db.execute(f"INSERT INTO main.{_quoted(table)} SELECT * FROM part.{_quoted(table)} ORDER BY rowid")
                db.execute("COMMIT")
                db.execute("DETACH part")
                os.unlink(path)
        finally:
            db.close()
        self._finish(made)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class TextFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_text_file"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(self.options["path"])


class TablesFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_sqlite_file"

    def writer(self, schema, overwrite: bool) -> TablesWriter:
        return TablesWriter(self.options["path"], json.loads(self.options["tables"]))

