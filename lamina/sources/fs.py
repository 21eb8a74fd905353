"""Small files and folders in whatever store Spark writes to, through Hadoop's file systems."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lamina.errors import StorageError


class Store:
    """Metadata of a few kilobytes each; table data never passes here."""

    def __init__(self, spark: SparkSession) -> None:
        self.new_array = spark.sparkContext._gateway.new_array
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def mkdirs(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing. Hidden names and checksums are left out."""
        fs, target = self._at(path)
        found = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(n for n in found if n[0] not in "._")

    def age(self, path: str) -> float:
        """Seconds since the last change of a file or of anything right in a folder; 0 if it is gone."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return 0.0
        times = [fs.getFileStatus(target).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(target))]
        return time.time() - max(times) / 1000

    def delete(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file whole; False if it is there already. This is the commit primitive.

        The text goes to a hidden file first, so no reader sees half of it; the rename
        fails where another writer was first.
        """
        fs, target = self._at(path)
        hidden = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
            context.rename(hidden, target, self.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; below a temporary one where that is unset and Spark is local.

    It is deleted when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise StorageError("set spark.checkpoint.dir to a folder that all hosts share")
    base = base or tempfile.mkdtemp(prefix="lamina-")
    path = f"{base.rstrip('/')}/lamina-{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            Store(spark).delete(path)

    atexit.register(gone)
    return path
