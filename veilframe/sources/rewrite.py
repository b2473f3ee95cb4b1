"""Changing rows of stored tables in place, file by file.

A Parquet table is not rewritten to change a few of its rows: the files that hold them are
found by their paths, what should be there instead is written beside them, and the files
are swapped.  Other files are neither read nor touched.

The swap is kept in a journal inside the table (``_rewrite-<id>``; names with an underscore
are no data): the changed rows and the list of files they stand for are complete before the
first file goes.  A run that was cut off is finished, or undone if it had not come so far,
by the next change of the table (``finish_rewrites``).  In the moment of the swap itself a
reader may miss the rows of the swapped files; it never sees erased rows again.  One change
of a table runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.staging import stage

JOURNAL = "_rewrite-"


class Files:
    """The file system of a table's folder, as the session is set up for it."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self._path, self._uri = context._jvm.org.apache.hadoop.fs.Path, context._jvm.java.net.URI
        self.fs = self._path(path).getFileSystem(context._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def delete_uri(self, uri: str) -> None:
        """Delete a file named as ``_metadata.file_path`` names it."""
        self.fs.delete(self._path(self._uri(uri)), False)

    def move(self, path: str, to: str) -> None:
        """Move a file; nothing to do if it was moved before."""
        target = self._path(to)
        if not self.fs.exists(self._path(path)):
            return
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self._path(path), target):
            raise OSError(f"cannot move {path} to {to}")

    def mark(self, folder: str, number: int) -> None:
        """Leave a number as the last mark of a folder."""
        self.fs.mkdirs(self._path(folder))
        self.fs.create(self._path(f"{folder}/{number}"), True).close()
        for old in self._marks(folder):
            if old < number:
                self.delete(f"{folder}/{old}")

    def last_mark(self, folder: str) -> int:
        """The last mark of a folder, -1 without one."""
        return max(self._marks(folder), default=-1)

    def _marks(self, folder: str) -> list[int]:
        if not self.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]
        return [int(name) for name in names if name.isdigit()]

    def folders(self, path: str, prefix: str) -> list[str]:
        if not self.exists(path):
            return []
        return [str(s.getPath()) for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().startswith(prefix)]

    def files(self, path: str) -> list[str]:
        """Data files below a folder, relative to it."""
        root = str(self.fs.getFileStatus(self._path(path)).getPath())
        found, left = self.fs.listFiles(self._path(path), True), []
        while found.hasNext():
            name = str(found.next().getPath())[len(root) + 1 :]
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                left.append(name)
        return left


def files_with(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``file, n``: the files of a stored table that hold rows of ``keys``, and how many.
    Only the key column is read."""
    located = table.select(F.col(key), F.col("_metadata.file_path").alias("file"))
    return located.join(keys.select(key).distinct(), key, "left_semi").groupBy("file").agg(F.count("*").alias("n"))


def rewrite_rows(
    spark: SparkSession,
    path: str,
    read: Callable[[], DataFrame],
    keys: DataFrame,
    key: str,
    change: Callable[[DataFrame], DataFrame],
    partition: str | None = "day",
) -> int:
    """Replace the rows of the files that hold a key of ``keys`` by what ``change`` makes of
    them (all rows of these files, with the table's columns), and give the number of files.

    ``read`` gives the table stored at ``path``, in folders by ``partition`` if it is set.
    A null key stands for no row."""
    finish_rewrites(spark, path)
    table = read()
    # one row per file, as many as the table's own listing has
    hit = sorted(row.file for row in files_with(table, keys, key).collect())
    if not hit:
        return 0
    journal = f"{path.rstrip('/')}/{JOURNAL}{uuid.uuid4().hex}"
    rows = change(table.where(F.col("_metadata.file_path").isin(hit)))
    writer = rows.select(table.columns).write
    (writer.partitionBy(partition) if partition else writer).parquet(f"{journal}/rows")
    spark.createDataFrame([(f,) for f in hit], "file string").coalesce(1).write.parquet(f"{journal}/old")
    _swap(spark, path, journal)
    return len(hit)


def finish_rewrites(spark: SparkSession, path: str) -> None:
    """Finish changes that were cut off; those without a complete journal changed nothing
    and are thrown away."""
    files = Files(spark, path)
    for journal in files.folders(path, JOURNAL):
        if all(files.exists(f"{journal}/{part}/_SUCCESS") for part in ("rows", "old")):
            _swap(spark, path, journal)
        else:
            files.delete(journal)


def _swap(spark: SparkSession, path: str, journal: str) -> None:
    """Take the old files away, then bring the new ones; may be repeated at any point."""
    files = Files(spark, path)
    for row in spark.read.schema("file string").parquet(f"{journal}/old").collect():
        files.delete_uri(row.file)
    tag = journal.rsplit(JOURNAL, 1)[-1]
    for name in files.files(f"{journal}/rows"):
        folder, _, file = name.rpartition("/")
        files.move(f"{journal}/rows/{name}", "/".join(filter(None, (path.rstrip("/"), folder, f"{tag}-{file}"))))
    files.delete(journal)


def erase_rows(
    spark: SparkSession, path: str, read: Callable[[], DataFrame], keys: DataFrame, key: str, partition: str | None = "day"
) -> int:
    """Erase the rows of a stored table whose ``key`` is in ``keys``; gives the number of
    files that were rewritten."""
    asked = stage(keys.select(key).where(F.col(key).isNotNull()).distinct())
    return rewrite_rows(spark, path, read, asked, key, lambda rows: rows.join(asked, key, "left_anti"), partition)
