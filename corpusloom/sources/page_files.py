"""A batch sink that writes a file for each page, on Spark's Python data source interface.

    write_files(pages, "/shared/out")                  # pages: file, ordinal, content

Tasks write to a staging folder beside the target; the job's commit renames it, so a reader sees all files or none,
and a job that fails leaves none. A task's file moves into the staging folder only when it is whole, so attempts that
are lost or run twice leave nothing half-written. The file system is found by the path's scheme (``pyarrow.fs``) and
must rename folders.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusloom.session import ship_package

#: Fixed value: what stands between documents that share a file.
BETWEEN = "\n\n---\n\n"
ATTEMPTS = "_attempts"
#: Fixed value: folders of the second file of a name, the third and so on.
AGAIN = "again-"


@dataclass
class Written(WriterCommitMessage):
    files: int


def guarded(path: str, root: str | None) -> str:
    """The normal form of ``path``; an error where it does not lie within ``root``."""
    normal = posixpath.normpath(path)
    if root is not None:
        base = posixpath.normpath(root)
        if posixpath.commonpath([normal, base]) != base:
            raise ValueError(f"{path} is outside {root}")
    return normal


def file_name(name: str | None) -> str:
    """``name`` if it names a file within a folder, else an error."""
    if not name or "/" in name or "\\" in name or "\0" in name or name in (".", "..", ATTEMPTS) or name.removeprefix(AGAIN).isdigit() and name.startswith(AGAIN):
        raise ValueError(f"not a file name: {name!r}")
    return name


class PageFilesWriter(DataSourceWriter):
    """Rows (file, content), those of one file one after another in one task: joined, all kept in folders, or the last one stays."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        system, path = fs.FileSystem.from_uri(options["path"]) if ":/" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.system, self.target = system, guarded(path, options.get("root"))
        self.joined, self.every, self.overwrite = options.get("joined", "false") == "true", options.get("every", "false") == "true", overwrite
        if not overwrite and self._there(self.target):
            raise ValueError(f"{self.target} exists already")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def _there(self, path: str) -> bool:
        return self.system.get_file_info(path).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        own = f"{self.staging}/{ATTEMPTS}/{TaskContext.get().taskAttemptId()}"
        self.system.create_dir(own, recursive=True)
        last, out, files, again = None, None, 0, 0
        for file, content in iterator:
            file, piece = file_name(file), (content or "").encode()
            if file == last and self.joined:
                out.write(BETWEEN.encode() + piece)
                continue
            if out:
                out.close()
                if file != last or self.every:
                    self._keep(own, last, again)
                    files += 1
                again = again + 1 if file == last else 0
            last, out = file, self.system.open_output_stream(f"{own}/{file}")
            out.write(piece)
        if out:
            out.close()
            self._keep(own, last, again)
            files += 1
        return Written(files)

    def _keep(self, own: str, file: str, again: int) -> None:
        folder = self.staging
        if self.every and again:
            folder = f"{folder}/{AGAIN}{again}"
            self.system.create_dir(folder, recursive=True)
        self.system.move(f"{own}/{file}", f"{folder}/{file}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.system.create_dir(f"{self.staging}/{ATTEMPTS}", recursive=True)
        self.system.delete_dir(f"{self.staging}/{ATTEMPTS}")
        old = f"{self.staging}-replaced"
        replaced = self.overwrite and self._there(self.target)
        if replaced:
            self.system.move(self.target, old)
        self.system.move(self.staging, self.target)
        if replaced:
            self.system.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self._there(self.staging):
            self.system.delete_dir(self.staging)


class PageFiles(DataSource):
    """Format ``page_files``; options: path, root (the target must lie within it), joined."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema: StructType, overwrite: bool) -> PageFilesWriter:
        return PageFilesWriter(dict(self.options), overwrite)


def write_files(pages: DataFrame, path: str, root: str | None = None, joined: bool = False, overwrite: bool = False, every: bool = False) -> None:
    """Write ``pages`` (file, ordinal, content) as files of those names; a null content is an empty file.

    Of rows with one name the last by ordinal stays; if ``joined``, they stand in one file with a rule between; if
    ``every``, the first has the name in ``path`` and the later ones in the folders ``again-1``, ``again-2`` and so on. A
    file has one writer, which streams its rows: no file is held in memory. A target that exists is an error unless
    ``overwrite``, and so is a name with folders in it.
    """
    spark = pages.sparkSession
    ship_package(spark)
    spark.dataSource.register(PageFiles)
    # by a hash of the name: a repartition by the very key of a join before it would be dropped
    rows = pages.repartition(F.xxhash64("file")).sortWithinPartitions("file", "ordinal").select("file", "content")
    writer = rows.write.format("page_files").mode("overwrite" if overwrite else "append").option("joined", str(joined).lower()).option("every", str(every).lower())
    (writer.option("root", root) if root else writer).save(path)
