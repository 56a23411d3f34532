"""Exclusive commits: a numbered file that only one writer can create, and only whole.

The step is an exclusive hard link on local and mounted file systems, and a rename without
overwriting on HDFS. On other file systems (object stores above all) neither is known to be
exclusive, and a commit is refused.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed since this one began."""


class Files:
    """The few calls on the folder's file system that the driver makes."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.system = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder, with their time in ms."""
        if not self.system.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.system.listStatus(self.path(folder))]

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def put_new(self, name: str, text: str) -> None:
        """Create a file with all its content, or raise `Conflict` if there is one."""
        scheme, folder = self.system.getUri().getScheme(), os.path.dirname(name)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        self.system.mkdirs(self.path(folder))
        if scheme not in ("file", "hdfs"):
            raise RuntimeError(f"no exclusive commit is known for {scheme}: files")
        out = self.system.create(self.path(draft))
        out.write(text.encode())
        out.close()
        if scheme == "file":
            local = lambda x: urlparse(x).path
            try:
                os.link(local(draft), local(name))
            except FileExistsError:
                raise Conflict(f"{name} was written by another run") from None
            finally:
                os.unlink(local(draft))
        elif not self.system.rename(self.path(draft), self.path(name)):
            self.delete(draft)
            raise Conflict(f"{name} was written by another run")

    def numbers(self, folder: str) -> list[int]:
        """Numbers of the commits in a folder."""
        names = [name for name, _ in self.names(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def numbered(folder: str, number: int) -> str:
    return f"{folder}/{number:020d}.json"
