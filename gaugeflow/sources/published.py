"""Small records and folders that appear at once, on any Hadoop-compatible file system.

Readers see a record or folder whole or not at all: it is written under another name and renamed. A record
can also be claimed, which succeeds for one writer only. Needs a file system whose renames of a
folder or file are atomic (HDFS and its kind, local disks).
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """Paths under ``root``, given relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop("").getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(name))

    def names(self, name: str = "") -> list[str]:
        """Names inside a folder, sorted; none if it is missing."""
        if not self.exists(name):
            return []
        return sorted(st.getPath().getName() for st in self._fs.listStatus(self._hadoop(name)))

    def files(self, name: str = "") -> list[str]:
        """Paths of all files below a folder, relative to it and sorted."""
        if not self.exists(name):
            return []
        base, found = self._fs.makeQualified(self._hadoop(name)).toString().rstrip("/") + "/", []
        each = self._fs.listFiles(self._hadoop(name), True)
        while each.hasNext():
            found.append(each.next().getPath().toString().removeprefix(base))
        return sorted(found)

    def read(self, name: str) -> dict | None:
        """A record; None if there is none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._hadoop(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _local(self, name: str) -> str | None:
        """The path on a local disk, whose Hadoop client creates and replaces files in two steps; None elsewhere."""
        uri = self._fs.makeQualified(self._hadoop(name)).toUri()
        if uri.getScheme() != "file":
            return None
        os.makedirs(os.path.dirname(uri.getPath()), exist_ok=True)
        return uri.getPath()

    def write(self, name: str, record: dict) -> None:
        """Put a record in place, in one step instead of any earlier one."""
        data, part = json.dumps(record, sort_keys=True).encode(), f"{name}.{uuid.uuid4().hex}.part"
        local = self._local(part)
        if local:
            with open(local, "wb") as out:
                out.write(data)
            os.replace(local, self._local(name))
            return
        out = self._fs.create(self._hadoop(part), True)
        try:
            out.write(data)
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context.rename(self._fs.makeQualified(self._hadoop(part)), self._fs.makeQualified(self._hadoop(name)), how)

    def claim(self, name: str) -> bool:
        """Create an empty record; False if another writer did so before."""
        local = self._local(name)
        if local:
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(self._hadoop(name), False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def publish(self, staged: str, name: str) -> bool:
        """Rename a finished folder into place; False (and nothing changes) if it is there already."""
        if self.exists(name):
            return False
        target = self._hadoop(name)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._hadoop(staged), target):
            raise OSError(f"cannot publish {self.path(name)}")
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._hadoop(name), True)

    def make_folder(self, name: str) -> None:
        self._fs.mkdirs(self._hadoop(name))
