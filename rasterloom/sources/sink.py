"""A data source that writes a binary column as files, published by commit: all files of a job appear, or none.

Each attempt of a task writes to a folder of its own below the target; the commit moves the files of those attempts that Spark accepted, and
what retried, speculative and failed attempts left is removed. Paths may be of any file system that Arrow knows (file, hdfs, s3).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "rasterloom_files"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Attempt(WriterCommitMessage):
    """What an accepted attempt left: its folder and how many files lie there."""

    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, extension: str):
        self.path, self.overwrite, self.extension = path.rstrip("/"), overwrite, extension
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        # Made here, before any task: an attempt that still runs when the job is given up can't bring it back.
        where, staging = located(self.staging)
        where.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Attempt:
        """Rows with null content are left out: their error stays in the table that they came from."""
        where, _ = located(self.path)
        folder = f"{located(self.staging)[1]}/{uuid.uuid4().hex}"
        where.create_dir(folder, recursive=False)
        seen: set[str] = set()
        for row in iterator:
            name, content = str(row["name"]), row["content"]
            if content is None:
                continue
            if "/" in name or name in ("", ".", "..", "None") or name.startswith("_staging-"):
                raise ValueError(f"not a name for a file: {name}")
            if name in seen:
                raise ValueError(f"two files of one name: {name}")
            seen.add(name)
            with where.open_output_stream(f"{folder}/{name}{self.extension}") as out:
                out.write(bytes(content))
        return Attempt(folder, len(seen))

    def commit(self, messages: list[Attempt | None]) -> None:
        where, target = located(self.path)
        try:
            moves: dict[str, str] = {}
            for m in messages:
                for f in where.get_file_info(fs.FileSelector(m.folder)) if m else []:
                    if f.base_name in moves:
                        raise ValueError(f"two files of one name: {f.base_name}")
                    moves[f.base_name] = f.path
            if self.overwrite:
                here = where.get_file_info(fs.FileSelector(target))
                for f in here:
                    if f.type == fs.FileType.File and f.base_name.endswith(self.extension) and f.base_name not in moves:
                        where.delete_file(f.path)
            for name, path in moves.items():
                where.move(path, f"{target}/{name}")
        finally:
            self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, staging = located(self.staging)
        for tries in range(5, 0, -1):
            try:
                if where.get_file_info(staging).type == fs.FileType.Directory:
                    where.delete_dir(staging)
                return
            except OSError:  # an attempt that still runs wrote there meanwhile
                if tries == 1:
                    raise


class Files(DataSource):
    """Options: path (needed) and extension (put behind each name). Columns: name, content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if "path" not in self.options:
            raise ValueError("path is missing")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("columns name and content are needed")
        return FileWriter(self.options["path"], overwrite, self.options.get("extension", ""))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session: df.write.format("rasterloom_files").mode("append").option("extension", ".png").save(folder)."""
    spark.dataSource.register(Files)


def save(files: DataFrame, folder: str, name: str = "image_id", content: str = "content", extension: str = "", overwrite: bool = False) -> None:
    """Writes the rows of files that have content to folder, each under its name: all or, on an error, none.

    Two rows of one name and names that aren't those of a file are errors. overwrite removes other files of the extension from the folder. An empty
    table writes nothing. Moving is done by the driver, one call for each file; contents never reach it.
    """
    register(files.sparkSession)
    d = files.select(files[name].cast("string").alias("name"), files[content].alias("content"))
    d.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("extension", extension).save(folder)
