"""Small files through Hadoop's file systems, so that a store may be anywhere that Spark reads."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one where none is set, in local mode only."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidemark-"))
    return configured or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared one, deleted when the block ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        Files(spark, path).remove("")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} leaves the store")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        self._path(name)
        return f"{self.root}/{name}"

    def list(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read_at(self, name: str, offset: int, size: int) -> bytes:
        """So many bytes from a place on; fewer where the file ends."""
        stream = self._fs.open(self._path(name))
        try:
            stream.seek(min(offset, self.size(name)))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """Writes under a name of its own, then renames; an existing name is an error.

        The rename itself refuses an existing name on file systems such as HDFS; elsewhere it is looked for just before.
        """
        final, draft = self._path(name), self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, True)
            raise FileExistsError(f"{name} was published by another writer")

    def create(self, name: str, data: bytes) -> None:
        """Creates a file that must not exist."""
        path = self._path(name)
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            raise FileExistsError(f"{name} exists") from e
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        """Idempotent."""
        self._fs.delete(self._path(name), True)
