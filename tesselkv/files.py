"""Small metadata files on any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A folder; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, name: str) -> int:
        path = self._path(name)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """A new file that appears whole; False if it exists already."""
        hidden, final = self._path(f"{name}.writing"), self._path(name)
        if self._fs.exists(final):
            return False
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(data))
        stream.close()
        return self._fs.rename(hidden, final)

    def create_new(self, name: str, data: bytes) -> bool:
        """A new file, made by one of several that try at once."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def modified(self, name: str) -> float:
        """Seconds since the epoch by the file system's clock; 0 if there is no such file."""
        path = self._path(name)
        return self._fs.getFileStatus(path).getModificationTime() / 1000 if self._fs.exists(path) else 0.0

    def touch(self, name: str, at: float) -> None:
        self._fs.setTimes(self._path(name), int(at * 1000), -1)

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._path(name), self._path(to))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
