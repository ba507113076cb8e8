"""Folders as a data source: every entry under a root, and rows written as files.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("skip", ".git").load(root)
    rows.write.format("folder").mode("append").save(root)

Reading gives ``file, path, is_folder, mtime, size`` of all entries, hidden and empty ones too
(Spark's own readers pass over names that start with a dot or an underscore), without opening
a file. Skipped folders aren't entered. The walk is cut into at least ``TASKS`` subtrees
where there are so many folders. Planning keeps names of folders only, ``WIDE`` of a folder at most:
entries of the folders above the subtrees, or of one with more folders, are shared out by a hash
of their names, and each task lists the folder for its own share of ``SHARE`` or so.

Writing takes ``file, content`` (text or bytes; null is an empty file) and creates parents.
Tasks write beside the root's own entries, in a folder of the job, ``SHARE`` files a subfolder; the
driver moves files into place, a subfolder at a time, when all tasks have ended, so a failed job
leaves nothing, and a repeated task nothing twice. A task tells the driver how many subfolders it
has written, and no names.

Paths are local, or URIs that Arrow's file systems know.
"""

from __future__ import annotations

import os
import stat
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENTRY = "file string, path string, is_folder boolean, mtime double, size long"
TASKS = 64
#: Entries that a task lists of a shared folder, and files that it writes into one subfolder.
SHARE = 10_000
#: Folders of one folder that planning holds.
WIDE = 1000
_STAGE = ".being-written-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a local path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def there(path: str) -> bool:
    store, plain = opened(path)
    return store.get_file_info(plain).type == fs.FileType.Directory


@dataclass
class Subtree(InputPartition):
    """Folders with the share to list (``k`` of ``n``), and whether to walk what is below it."""

    shares: list[tuple[str, int, int, bool]]

    def __post_init__(self) -> None:
        super().__init__(self.shares)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)
        self.deep = options.get("recursive", "true").lower() == "true"

    def _names(self, folder: str) -> Iterator[tuple[str, bool, os.DirEntry | fs.FileInfo]]:
        """Name under the root, whether it is a folder, and what tells more, of entries right under ``folder``."""
        store, root = opened(self.root)
        at = f"{root}/{folder}" if folder else root
        own = lambda name: name in self.skip or name.startswith(_STAGE)
        full = lambda name: f"{folder}/{name}" if folder else name
        if isinstance(store, fs.LocalFileSystem):  # one by one, however many there are
            with os.scandir(at or "/") as found:
                yield from ((full(x.name), x.is_dir(), x) for x in found if not own(x.name))
        else:
            yield from ((full(x.base_name), x.type == fs.FileType.Directory, x) for x in store.get_file_info(fs.FileSelector(at)) if not own(x.base_name))

    def _row(self, name: str, down: bool, x: os.DirEntry | fs.FileInfo) -> tuple:
        if isinstance(x, fs.FileInfo):
            return name, f"{self.root}/{name}", down, (x.mtime_ns or 0) / 1e9, None if down else x.size
        try:
            s = x.stat()
        except OSError:  # gone meanwhile, or a link to nothing
            return name, f"{self.root}/{name}", down, 0.0, None
        return name, f"{self.root}/{name}", down, s.st_mtime_ns / 1e9, s.st_size if stat.S_ISREG(s.st_mode) else None

    def partitions(self) -> list[Subtree]:
        if not there(self.root):
            raise FileNotFoundError(self.root)
        level, shares, total, wide = [""], [], 0, False
        while level and len(level) < TASKS:
            below = []
            for folder in level:
                n, folders = 0, []
                for name, down, _ in self._names(folder):
                    n += 1
                    if down and self.deep and len(folders) <= WIDE:
                        folders.append(name)
                deep = len(folders) > WIDE
                parts = TASKS if deep else min(TASKS, n // SHARE + 1)
                shares += [(folder, k, parts, deep) for k in range(parts)]
                below += [] if deep else folders
                total, wide = total + n, wide or deep
            level = below
        shares += [(folder, 0, 1, True) for folder in level]
        n = TASKS if wide else min(TASKS, len(level) + total // SHARE + 1)
        return [Subtree(shares[k::n]) for k in range(n)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = list(partition.shares)
        while todo:
            folder, k, n, deep = todo.pop()
            for name, down, x in self._names(folder):
                if n > 1 and zlib.crc32(os.fsencode(name)) % n != k:
                    continue
                yield self._row(name, down, x)
                if down and deep:
                    todo.append((name, 0, 1, True))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    parts: int


class FolderWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root = options["path"].rstrip("/")
        self.stage = f"{self.root}/{_STAGE}{uuid.uuid4().hex}"
        self.at = {c: schema.fieldNames().index(c) for c in ("file", "content")}

    def write(self, rows: Iterator) -> Written:
        store, stage = opened(self.stage)
        own, n = uuid.uuid4().hex, 0
        for row in rows:
            name, content = row[self.at["file"]], row[self.at["content"]]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a file under the root: {name!r}")
            to = f"{own}/{n // SHARE}/{name}"
            store.create_dir(f"{stage}/{to}".rpartition("/")[0])
            with store.open_output_stream(f"{stage}/{to}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            n += 1
        return Written(own, -(-n // SHARE))

    def commit(self, messages: list[Written | None]) -> None:
        store, stage = opened(self.stage)
        root = stage.rpartition("/")[0]
        for message in filter(None, messages):
            for part in range(message.parts):
                under, made = f"{stage}/{message.folder}/{part}", set()
                for x in store.get_file_info(fs.FileSelector(under, recursive=True)):
                    if x.type != fs.FileType.File:
                        continue
                    to = f"{root}/{x.path.removeprefix(under + '/')}"
                    if (parent := to.rpartition("/")[0]) not in made:
                        store.create_dir(parent)
                        made.add(parent)
                    store.move(x.path, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, stage = opened(self.stage)
        if store.get_file_info(stage).type == fs.FileType.Directory:
            store.delete_dir(stage)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), schema, overwrite)
