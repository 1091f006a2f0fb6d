"""Names and small texts below a path in the shared file system, by the session's own file system classes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder that all executors and the driver see; parts of a path are given one by one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, *parts: str) -> list[str]:
        files, path = self.at(*parts)
        return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []

    def text(self, *parts: str) -> str:
        files, path = self.at(*parts)
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *parts: str, overwrite: bool = False) -> bool:
        """Writes a small file; False when it is there already and may not be overwritten."""
        files, path = self.at(*parts)
        try:
            stream = files.create(path, overwrite)
        except Py4JJavaError as error:
            if not overwrite and "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True

    def drop(self, *parts: str) -> None:
        files, path = self.at(*parts)
        files.delete(path, True)
