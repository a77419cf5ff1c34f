"""Small file operations through Hadoop's file systems, so that a store can lie wherever Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, name: str = "") -> int:
        path = self._path(name)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False if the name is taken."""
        temporary = self._path(f".{name}.{self._jvm.java.util.UUID.randomUUID().toString()}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        if not self.exists(name) and self._fs.rename(temporary, self._path(name)):
            return True
        self._fs.delete(temporary, False)
        return False

    def copy_to(self, name: str, other: Files) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), other._fs, other._path(name), False, self._conf)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
