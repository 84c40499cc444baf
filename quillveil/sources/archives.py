"""Documents as a data source of Spark: archives read with the entries asked for, and documents written as one file each.

`register(spark)` makes two formats known. `word_archives` reads a folder's Word archives (options: entries, comma-separated names
or prefixes that end in a star; suffix). `document_files` writes rows (name, content) as files of those names. Both reach any store that pyarrow opens by its
address; all machines must reach it.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from .docx import DOCUMENT

#: Bytes of archives in one partition, about, and files at most.
SPLIT, FILES = 64 << 20, 10_000
#: Folders and files of the writer's own begin with an underscore, as Spark's do; readers pass them over.
PENDING, MANIFESTS = "_pending", "_manifests"


@dataclass
class Listed(InputPartition):
    files: tuple[tuple[str, int], ...]


def _wanted(name: str, entries: tuple[str, ...]) -> bool:
    return not entries or any(name.startswith(e[:-1]) if e.endswith("*") else name == e for e in entries)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".docx").lower()
        self.entries = tuple(e.strip() for e in options.get("entries", "").split(",") if e.strip())
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the name are met by the listing: files that don't meet them are never opened."""
        for f in filters:
            if isinstance(f, (EqualTo, StringEndsWith, StringStartsWith)) and tuple(f.attribute) == ("name",):
                self.names.append(f)
            else:
                yield f

    def _listed(self, name: str) -> bool:
        tests = {EqualTo: str.__eq__, StringEndsWith: str.endswith, StringStartsWith: str.startswith}
        return name.lower().endswith(self.suffix) and all(tests[type(f)](name, f.value) for f in self.names)

    def partitions(self) -> list[Listed]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        parts, held, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            inner = info.path[len(root) :].strip("/")
            if info.type != fs.FileType.File or any(p[0] in "._" for p in inner.split("/")) or not self._listed(info.base_name):
                continue
            if held and (size + info.size > SPLIT or len(held) == FILES):
                parts.append(Listed(tuple(held)))
                held, size = [], 0
            held.append((info.path, info.size))
            size += info.size
        return [*parts, Listed(tuple(held))]  # one at least: without any, Spark calls read() with none

    def read(self, partition: Listed) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size in partition.files:
            parts, error = {}, None
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    if DOCUMENT not in names:
                        raise ValueError(f"no {DOCUMENT}")
                    parts = {n: z.read(n) for n in names if _wanted(n, self.entries)}  # others stay packed
            except Exception as e:
                error = str(e)
            yield path.rpartition("/")[2], size, parts, error


class WordArchives(DataSource):
    """(name, size, parts, error) of a folder's archives; one that can't be read has an error and no parts."""

    @classmethod
    def name(cls) -> str:
        return "word_archives"

    def schema(self) -> str:
        return "name string, size bigint, parts map<string,binary>, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    files: int
    bytes: int


class FileWriter(DataSourceWriter):
    """A task writes its files aside and moves them to their names when all are written; it lists them before it moves them, so that a job that
    fails can take them back. A task that runs again replaces what it wrote."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        aside = f"{root}/{PENDING}-{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        manifest = f"{root}/{MANIFESTS}-{self.run}/{task.partitionId()}"
        store.create_dir(aside)
        store.create_dir(manifest.rpartition("/")[0])
        names, total = [], 0
        for row in rows:
            name, content = row["name"], bytes(row["content"] or b"")
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"no name of a file: {name!r}")
            with store.open_output_stream(f"{aside}/{len(names)}") as f:
                f.write(content)
            names.append(name)
            total += len(content)
        if len(set(names)) < len(names):
            raise ValueError("two documents of one name")
        with store.open_output_stream(manifest) as f:
            f.write("\n".join(names).encode())
        for k, name in enumerate(names):
            if not self.overwrite and task.attemptNumber() == 0 and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                raise FileExistsError(name)
            store.move(f"{aside}/{k}", f"{root}/{name}")
        return Written(manifest, len(names), total)

    def _done(self) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for folder in (PENDING, MANIFESTS):
            if store.get_file_info(f"{root}/{folder}-{self.run}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{folder}-{self.run}")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} files, {sum(m.bytes for m in messages if m)} bytes\n".encode())
        self._done()

    def abort(self, messages: list[Written | None]) -> None:
        """Take back the files of the tasks that had ended: those that replaced others are gone, too."""
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                with store.open_input_file(m.manifest) as f:
                    for name in io.TextIOWrapper(f, "utf-8"):
                        if store.get_file_info(f"{root}/{name.rstrip(chr(10))}").type == fs.FileType.File:
                            store.delete_file(f"{root}/{name.rstrip(chr(10))}")
        self._done()


class DocumentFiles(DataSource):
    """Rows (name string, content binary) as files of those names; names of a job must differ, and without overwriting mustn't be there yet."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("columns name and content are needed")
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let it hand conditions down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordArchives)
    spark.dataSource.register(DocumentFiles)
