"""A data source that writes rows as files: each task into a folder of its own, moved into place when the job commits."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Files that are moved at a time by the commit.
THREADS = 16


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt."""

    folder: str


class FileWriter(DataSourceWriter):
    """Attempts write below ``.staging``; a commit moves the files of those that Spark names, so a task that ran twice leaves one file."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = os.path.join(root, ".staging", uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Written:
        context = TaskContext.get()
        folder = os.path.join(self.staging, f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = row["target"]
            if path is None or os.path.isabs(path) or ".." in path.split("/"):
                raise ValueError(f"not a path below the root: {path!r}")
            place = os.path.join(folder, path)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place, "xb") as out:
                out.write(row["content"] or b"")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        moves = []
        for m in messages:
            for folder, _, names in os.walk(m.folder) if m else ():
                moves += [(os.path.join(folder, n), os.path.join(self.root, os.path.relpath(os.path.join(folder, n), m.folder))) for n in names]
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(self._move, moves))
        self._clear()

    def _move(self, move: tuple[str, str]) -> None:
        source, target = move
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if self.overwrite:
            os.replace(source, target)
        else:
            try:
                os.link(source, target)  # fails where there is a file, which stays
            except FileExistsError:
                pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.staging))
        except OSError:
            pass  # another job's


class FileSink(DataSource):
    """``format("files")`` with options path and overwrite, for rows (target, content)."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "target string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"].removeprefix("file://").rstrip("/"), self.options.get("overwrite", "false").lower() == "true")


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write each row (target, content) as a file below ``root``, which the driver and all executors see.

    Files that are there are kept unless ``overwrite``. Nothing is in place before all tasks have ended; a failed job
    leaves nothing. Targets are distinct, as those of ``output_targets`` are; null contents are empty files.
    """
    rows.sparkSession.dataSource.register(FileSink)
    out = rows.select(rows["target"].cast("string"), rows["content"].cast("binary"))
    out.write.format("files").option("path", root).option("overwrite", str(overwrite).lower()).mode("append").save()
