"""One file a record, as a data source that commits: a job's files appear together, or not at all."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, STAGING = "tallyglass_files", "_staging"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a plain path on a shared mount, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many files it holds."""

    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own below the staging folder of the job. Commit moves each successful attempt's folder to its place, one
    move a task however many files; what failed or slower attempts left goes with the staging folder, at commit and at abort."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = located(self.path)
        folder = posixpath.join(base, STAGING, self.job, uuid.uuid4().hex)
        files.create_dir(folder, recursive=True)
        taken: dict[str, int] = {}
        n = 0
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("json").to_pylist()):
                name = re.sub(r"[/\\\x00]", "_", name or "null_result.json")
                taken[name] = k = taken.get(name, 0) + 1
                if k > 1:
                    stem, dot, end = name.rpartition(".")
                    name = f"{stem or end} ({k}){dot if stem else ''}{end if stem else ''}"
                with files.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(json.dumps(json.loads(text), indent=4, ensure_ascii=False).encode())
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = located(self.path)
        old = [i.path for i in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if posixpath.basename(i.path) != STAGING] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None):
            if m.files:
                files.move(m.folder, posixpath.join(base, f"part-{k:05d}-{self.job}"))
        for path in old:
            files.delete_dir(path) if files.get_file_info(path).type == fs.FileType.Directory else files.delete_file(path)
        self._clear(files, base)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(posixpath.join(base, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        """Delete this job's staging folder, and the one above if no other job is writing."""
        top = posixpath.join(base, STAGING)
        own = posixpath.join(top, self.job)
        if files.get_file_info(own).type != fs.FileType.NotFound:
            files.delete_dir(own)
        if files.get_file_info(top).type != fs.FileType.NotFound and not files.get_file_info(fs.FileSelector(top)):
            files.delete_dir(top)


class RecordFiles(DataSource):
    """Rows (name, json) as files of those names, in a folder a task below the option `path`. Names that recur within a task are numbered; signs that part folders become underscores; a row
    whose text isn't JSON fails its task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, json string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if "path" not in self.options:
            raise ValueError("a path to write to is needed")
        return FileWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> str:
    """The format's name, known to the session from now on."""
    spark.dataSource.register(RecordFiles)
    return FORMAT
