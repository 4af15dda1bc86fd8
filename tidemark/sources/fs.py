"""Small files on whatever file system a path names, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileSystem:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str, directories: bool | None = None) -> list[str]:
        """Names in a folder, sorted; none where there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if directories is None or s.isDirectory() == directories)

    def files(self, path: str) -> list[str]:
        """Names of the data files in a folder, sorted, as Spark lists them; however many, they come over in one string."""
        if not self.exists(path):
            return []
        found = self._spark.read.schema("x int").parquet(path)._jdf.inputFiles()
        return sorted(p.rsplit("/", 1)[-1] for p in self._jvm.org.apache.hadoop.util.StringUtils.join("\n", found).split("\n") if p)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False where one is there already."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def modified(self, path: str) -> float:
        return self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def under(self, path: str, depth: int) -> list[str]:
        """Paths of folders `depth` levels below, relative and sorted."""
        found = [""]
        for _ in range(depth):
            found = [f"{p}/{n}".lstrip("/") for p in found for n in self.names(f"{path}/{p}".rstrip("/"), True) if not n.startswith(("_", "."))]
        return found
