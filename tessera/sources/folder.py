"""A folder's files as a data source: partitions by folder, listed and read on executors, excluded folders never entered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tessera.operators.ingest import BINARY, SKIP_FILES, SKIP_PREFIXES, ignore_pattern

IGNORE_FILE = ".gitignore"
#: Folders that the driver lists to deal out the rest: until there are so many parts, and so deep at most.
PARTS, DEEP = 64, 3
#: Files in a batch of rows, and bytes (a longer file is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


@dataclass
class Part(InputPartition):
    """A folder, the ignore rules that hold in it, and whether its folders belong to it too."""

    folder: str
    rules: list[tuple[str, bool, bool]]
    deep: bool


def rule_of(line: str, folder: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file as (expression of the path itself, takes back in, folders only)."""
    found = ignore_pattern(line, folder)
    if found is None:
        return None
    for tail, only in (("/.*$", True), ("(?:/.*)?$", False)):
        if found[0].endswith(tail):
            return found[0][: -len(tail)] + "$", found[1], only
    return found[0], found[1], False


def excluded(path: str, is_folder: bool, rules: list[tuple[str, bool, bool]]) -> bool:
    """Whether the last rule that fits a path leaves it out."""
    for expression, back, only in reversed(rules):
        if (is_folder or not only) and re.match(expression, path):
            return not back
    return False


def indexable(path: str) -> bool:
    """As ingest.indexable: no skipped folder or file, no hidden one, no binary extension."""
    name = path.rpartition("/")[2]
    hidden = any(p.startswith(".") and len(p) > 1 for p in path.split("/"))
    stem, dot, extension = name.rpartition(".")
    return not (hidden or path.startswith(tuple(SKIP_PREFIXES)) or path.endswith(tuple(SKIP_FILES)) or (bool(stem and dot) and extension in BINARY))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.content = options["path"], options.get("content", "true") == "true"
        self.prefixes: list[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Paths that a filter names keep the walk to the folders that lead there; Spark checks the filters again."""
        for f in filters:
            found = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("file_path",) else list(f.value) if isinstance(f, In) and f.attribute == ("file_path",) else None
            if found is not None and all(isinstance(x, str) for x in found):
                self.prefixes = found if self.prefixes is None else [a for a in found if any(a.startswith(b) or b.startswith(a) for b in self.prefixes)]
            yield f

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root or self.root.startswith("file:"):
            store, base = fs.FileSystem.from_uri(self.root)
        else:
            store, base = fs.LocalFileSystem(), self.root
        return store, base.rstrip("/")

    def _leads(self, path: str, is_folder: bool) -> bool:
        if self.prefixes is None:
            return True
        return any(path.startswith(p) or (is_folder and p.startswith(path + "/")) for p in self.prefixes)

    def _listed(self, store: fs.FileSystem, base: str, part: Part) -> tuple[list[tuple[str, int]], list[Part]]:
        """The files of a folder that count, and its folders that do, with the rules that hold in them."""
        found = sorted(store.get_file_info(fs.FileSelector(f"{base}/{part.folder}".rstrip("/"))), key=lambda x: x.base_name)
        rules = list(part.rules)
        for x in found:
            if x.base_name == IGNORE_FILE and x.type == fs.FileType.File:
                with store.open_input_stream(x.path) as f:
                    lines = f.read().decode("utf-8", "replace").splitlines()
                rules += [r for r in (rule_of(line, part.folder) for line in lines) if r]
        files, folders = [], []
        for x in found:
            path = f"{part.folder}/{x.base_name}".lstrip("/")
            if x.type == fs.FileType.Directory:
                inside = f"{path}/x"  # a name that is neither hidden nor skipped itself
                if indexable(inside) and not excluded(path, True, rules) and self._leads(path, True):
                    folders.append(Part(path, rules, True))
            elif x.type == fs.FileType.File and indexable(path) and not excluded(path, False, rules) and self._leads(path, False):
                files.append((path, x.size))
        return files, folders

    def partitions(self) -> list[InputPartition]:
        """Folders near the top are listed here, so that those below are dealt out; all others are listed where they are read."""
        store, base = self._store()
        done, open_ = [], [Part("", [], True)]
        for _ in range(DEEP):
            if len(done) + len(open_) >= PARTS:
                break
            below = []
            for part in open_:
                files, folders = self._listed(store, base, part)
                if files:
                    done.append(Part(part.folder, part.rules, False))
                below += folders
            open_ = below
        return [*done, *open_] or [Part("", [], False)]  # an empty folder is a part too

    def _walk(self, part: Part) -> Iterator[tuple[str, int]]:
        store, base = self._store()
        left = [part]
        while left:
            at = left.pop()
            files, folders = self._listed(store, base, at)
            yield from files
            if at.deep:
                left += reversed(folders)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        names, kinds = ["file_path", "size", "content"], [pa.string(), pa.int64(), pa.string()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for path, size in self._walk(part):
            text = None
            if self.content:
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        text = f.read().decode("utf-8")
                except (UnicodeDecodeError, OSError):
                    continue  # neither text nor readable: left out
            rows.append((path, size, text))
            held += size if self.content else 0
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FolderSource(DataSource):
    """spark.read.format("folder").load(path): (file_path, size, content) of the text files under a folder.

    Ignore files hold for their folder and those below, deeper ones after shallower ones; nothing under an excluded
    folder comes back. With the option content=false files are listed and not read.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "file_path string, size long, content string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
