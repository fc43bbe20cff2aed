"""Small files in a folder that all machines share, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._at("")
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """Names of the entries of a folder, none if it does not exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def delete(self, name: str) -> None:
        """Removes a file, or a folder with all in it."""
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"could not move {self.path}/{name} to {to}")

    def write(self, name: str, text: str) -> None:
        """Replaces a small file: written beside it, then renamed."""
        beside = self._at(f"{name}.new")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(beside, self._at(name)):
            raise OSError(f"could not write {self.path}/{name}")

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()
