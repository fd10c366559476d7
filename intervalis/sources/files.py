"""File operations of the driver through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """A store under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Creates a file in one step; False if the name exists. Versions are committed by this, so two writers cannot both win.

        A local file appears by a hard link, which fails if the name exists; in HDFS a rename does. Other stores get the file by
        a create that does not overwrite; those that only emulate that (some object stores) need one writer at a time.
        """
        target, scheme = self._path(name), self.fs.getUri().getScheme()
        self.fs.mkdirs(target.getParent())
        if scheme not in ("file", "hdfs"):
            return self._create(target, text)
        temporary = self._path(f".{uuid.uuid4().hex}")
        self._create(temporary, text)
        try:
            if scheme == "hdfs":
                return self.fs.rename(temporary, target)
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(target), local(temporary))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(temporary, False)

    def _create(self, path, text: str) -> bool:
        try:
            stream = self.fs.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since the newest change of a file or of a folder's own entries."""
        status = self.fs.getFileStatus(self._path(name))
        newest = max([status.getModificationTime(), *(s.getModificationTime() for s in (self.fs.listStatus(self._path(name)) if status.isDirectory() else ()))])
        return time.time() - newest / 1000

    def copy(self, name: str, target: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(target)
        other = path.getFileSystem(self._conf)
        other.mkdirs(path.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), other, path, False, True, self._conf)
