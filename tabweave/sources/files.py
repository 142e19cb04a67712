"""Writers of single files: a JSON file for each table, and JSON lines that are there as soon as they are written.

Paths are URIs or local paths that all machines see. A file is written under another name and then moved, so none is ever seen half
written; a task that is run twice writes the same names again.
"""

import base64
import datetime
import decimal
import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _plain(x):
    """A value as JSON: times in ISO form, decimals as text, bytes in base 64."""
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(x).decode()
    return str(x) if isinstance(x, decimal.Decimal) else x


class _Folder:
    """A folder of the files of a job: those of a task stand in a hidden one until it has written all."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def write(self, name: str, text: str) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            out.write(text.encode())

    def move(self, a: str, b: str) -> None:
        try:
            self.fs.move(f"{self.root}/{a}", f"{self.root}/{b}")
        except OSError:  # some stores don't move onto a file that is there
            if self.fs.get_file_info(f"{self.root}/{b}").type != pafs.FileType.File:
                raise
            self.fs.delete_file(f"{self.root}/{b}")
            self.fs.move(f"{self.root}/{a}", f"{self.root}/{b}")

    def make(self, name: str) -> None:
        self.fs.create_dir(f"{self.root}/{name}" if name else self.root, recursive=True)

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/{name}")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: int
    rows: int


class TableFiles(DataSource):
    """A JSON file for each row, named by the column in option `name` ("table_id") with option `ending` (".json"), of the other columns. Option path: the folder; indent: as in JSON (2).

    A task moves its files into place when it has written all of them, so of one that fails none is seen; those of other tasks stay (of one
    that is stopped while it moves them, those moved; the rest stand in a hidden folder). When the job ends well, `_written.json` tells its files and rows. Slashes in a name become underscores; of rows that share a name, one stays.
    """

    @classmethod
    def name(cls) -> str:
        return "table_files"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _TableWriter(dict(self.options), schema.names)


class _JobWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.job = {k.lower(): v for k, v in options.items()}, names, uuid.uuid4().hex
        self.path = self.options["path"]
        _Folder(self.path).make("")

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        folder = _Folder(self.path)
        folder.drop(f"_tasks-{self.job}")
        folder.write("_written.json", json.dumps({"job": self.job, "files": sum(m.files for m in done), "rows": sum(m.rows for m in done)}))

    def abort(self, messages) -> None:
        _Folder(self.path).drop(f"_tasks-{self.job}")


class _TableWriter(_JobWriter):
    def write(self, iterator) -> Written:
        key, ending, indent = self.options.get("name", "table_id"), self.options.get("ending", ".json"), int(self.options.get("indent", 2))
        folder, task = _Folder(self.path), TaskContext.get()
        own, names, rows = f"_tasks-{self.job}/{task.taskAttemptId()}", set(), 0
        folder.make(own)
        for row in iterator:
            rows += 1
            name = str(row[key]).replace("/", "_") + ending
            folder.write(f"{own}/{name}", json.dumps({c: _plain(row[c]) for c in self.names if c != key}, indent=indent, ensure_ascii=False))
            names.add(name)
        for name in sorted(names):
            folder.move(f"{own}/{name}", name)
        return Written(task.partitionId(), len(names), rows)


class ResultLines(DataSource):
    """Rows as JSON lines, beside those that are there. Options: path; flush: rows after which a file is closed and seen (100).

    What a task wrote before it failed or was stopped is kept, up to the last whole file; if it is run again in the same job it writes the
    same names. A later run takes up what is left (`evaluate.remaining`).
    """

    @classmethod
    def name(cls) -> str:
        return "result_lines"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _LineWriter(dict(self.options), schema.names)


class Lines:
    """JSON lines of a task, a file for each `flush` of them, named by job and partition."""

    def __init__(self, path: str, job: str, flush: int = 1):
        self.folder, self.job, self.flush, self.held, self.files, task = _Folder(path), job, flush, [], 0, TaskContext.get()
        self.partition, self.own = task.partitionId(), f"_tasks-{job}/{task.taskAttemptId()}"
        self.folder.make(self.own)

    def add(self, row: dict) -> None:
        self.held.append(json.dumps(_plain(row), ensure_ascii=False))
        if len(self.held) >= self.flush:
            self.close()

    def close(self) -> None:
        if self.held:
            name = f"{self.job}-{self.partition:05d}-{self.files:05d}.json"
            self.folder.write(f"{self.own}/{name}", "".join(f"{x}\n" for x in self.held))
            self.folder.move(f"{self.own}/{name}", name)
            self.held, self.files = [], self.files + 1


class _LineWriter(_JobWriter):
    def write(self, iterator) -> Written:
        lines, rows = Lines(self.path, self.job, int(self.options.get("flush", 100))), 0
        for row in iterator:
            lines.add({c: row[c] for c in self.names})
            rows += 1
        lines.close()
        return Written(lines.partition, lines.files, rows)


def write_tables(tables: DataFrame, path: str, name: str = "table_id", **options) -> None:
    """A file for each table, as {columns, data, ...}."""
    tables.sparkSession.dataSource.register(TableFiles)
    writer = tables.write.format("table_files").mode("append").option("path", path).option("name", name)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()


def append_lines(rows: DataFrame, path: str, flush: int = 100) -> None:
    """Results beside those that are there. What a writer has got it keeps; Spark may hold rows back for it, so answers that are dear are kept where they are made (`worklists.by_client`)."""
    rows.sparkSession.dataSource.register(ResultLines)
    rows.write.format("result_lines").mode("append").option("path", path).option("flush", flush).save()


def write_text(path: str, text: str) -> None:
    """A single small file, from the driver."""
    root, name = path.rsplit("/", 1)
    folder = _Folder(root)
    folder.make("")
    folder.write(name, text)
