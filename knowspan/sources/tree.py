"""A tree of files as a data source: a partition for each directory, excluded ones never listed, only heads read.

``spark.read.format("file_tree").load(root)`` lists the directories when it is planned and the files in tasks, so
the tree has to be mounted on the driver and the executors alike; trees in other stores are read by ``files.walk``.

Options: ``extensions`` (".md,.html"), ``exclude`` (names of directories, separated by commas), ``whitelist`` (paths that
are read although a directory above them is excluded), ``own`` (the folder of our own data, never read), ``head`` (bytes of
content, 0 by default). Links are never followed. A filter on ``name`` by equality or on ``path`` by its beginning prunes the
listing. Directories and files that can't be read, or vanish meanwhile, are left out.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from knowspan.config import Gate

SCHEMA = "path string, name string, size bigint, mtime timestamp, head binary"
#: Directories of a task; one listing is small.
DIRECTORIES = 32


class Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


def _listed(folder: str) -> list[os.DirEntry]:
    """Entries of a directory; a hook of its own, so that tests can count what is listed."""
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:
        return []


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        many = lambda name, default="": [x.strip() for x in options.get(name, default).split(",") if x.strip()]
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.extensions = tuple(x.lower() for x in many("extensions", ".md,.html"))
        self.exclude, self.own = set(many("exclude")), options.get("own", "").rstrip("/")
        self.whitelist = [w.rstrip("/") for w in many("whitelist")]
        self.head = int(options.get("head", "0"))
        self.name: str | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.name = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f  # Spark checks them again

    def _allowed(self, path: str) -> bool:
        """A directory that is read: none of its segments below the root is excluded, or a whitelisted path is it, holds it or lies in it."""
        if self.own and (path == self.own or path.startswith(self.own + "/")):
            return False
        if any(path == w or path.startswith(w + "/") or w.startswith(path + "/") for w in self.whitelist):
            return True
        return not self.exclude & set(path[len(self.root) :].split("/"))

    def _relevant(self, path: str) -> bool:
        """The directory may hold paths that begin with the prefix."""
        return not self.prefix or self.prefix.startswith(path + "/") or (path + "/").startswith(self.prefix)

    def partitions(self) -> list[Folders]:
        todo, found = [self.root], []
        while todo:
            folder = todo.pop()
            found.append(folder)
            for e in _listed(folder):
                if e.is_dir(follow_symlinks=False) and self._allowed(e.path) and self._relevant(e.path):
                    todo.append(e.path)
        return [Folders(found[k : k + DIRECTORIES]) for k in range(0, len(found), DIRECTORIES)] or [Folders([])]

    def _kept(self, e: os.DirEntry, folder: str) -> bool:
        if e.is_symlink() or not e.name.lower().endswith(self.extensions) or (self.name is not None and e.name != self.name) or not e.path.startswith(self.prefix):
            return False
        # a directory that was only entered on the way to a whitelisted path below it gives no other files
        inside = self.exclude & set(folder[len(self.root) :].split("/"))
        return not inside or any(e.path == w or e.path.startswith(w + "/") for w in self.whitelist)

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            for e in _listed(folder):
                try:
                    if not e.is_file(follow_symlinks=False) or not self._kept(e, folder):
                        continue
                    at, head = e.stat(follow_symlinks=False), None
                    if self.head:
                        with open(e.path, "rb") as f:
                            head = f.read(self.head)
                    yield e.path, e.name, at.st_size, dt.datetime.fromtimestamp(at.st_mtime, dt.timezone.utc), head
                except OSError:
                    continue


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, gate: Gate = Gate(), head: int = 0, **options: str) -> DataFrame:
    """path, name, size, mtime, head of the files that the rules of a gate let in by their place."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("exclude", ",".join(gate.exclude_dirs)).option("whitelist", ",".join(gate.path_whitelist)).option("head", str(head))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(root)


def digests(files: DataFrame) -> DataFrame:
    """Adds md5, read from the mounted file in pieces; null where it is gone."""
    import hashlib

    import pyarrow as pa

    def one(path: str | None) -> str | None:
        try:
            with open(path, "rb") as f:
                return hashlib.file_digest(f, "md5").hexdigest()
        except (OSError, TypeError):
            return None

    def run(batches):
        for batch in batches:
            md5 = pa.array([one(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, md5], [*batch.schema.names, "md5"])

    return files.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in files.dtypes) + ", md5 string")


def external_entries(spark: SparkSession, root: str, cut: int = 200) -> DataFrame:
    """path and the metadata of the Markdown entries below ``root``: title, source, confidence, tags, updated and summary; hidden folders are skipped."""
    from knowspan.functions import entries

    files = tree(spark, root, Gate(), head=64 << 10, extensions=".md").where(~F.col("path").rlike(r"/\."))
    return files.select("path", "size", "mtime", entries.entry_fields(F.decode("head", "UTF-8")).alias("m")).select("path", "size", "mtime", "m.*")
